"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (``html_blocks``); features of a block are its ancestors' tags and what their names tell, its text's shape and
its surroundings' density of words and links; neighbours are tied by whether they have the same parent.  The field is trained
on ``PAGES`` labelled pages (``page_samples``), a number that does not grow with the input, and every page is decoded whole
by Viterbi.  Main blocks are joined in page order by one line break.

Null, empty and unparsable html give an empty text.  Rows are worked on one by one: repeated rows come out repeated, order and ties
do not matter, time is linear in the length of a page and nothing is cut.  An empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import crf, page_samples
from tidewatch.llm.html_blocks import Block, blocks, features

PAGES = 400  # labelled pages to train on
HELD_BYTES = 1 << 22  # text held by a task before it is handed on


def _named(path: frozenset[str], near: frozenset[str]) -> list[str]:
    return [f"in {f}" for f in path] + [f"near {f}" for f in near or ("nothing",)]


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = 20) -> crf.Model:
    """The field, trained on labelled pages; the same on every run."""
    return train(page_samples.labelled_pages(pages, seed))


def train(marked: list[str]) -> crf.Model:
    """Train on pages in which main text begins with ``page_samples.MARK``."""
    sequences = []
    for html in marked:
        found = blocks(html)
        labels = [int(b.text.startswith(page_samples.MARK)) for b in found]
        found = [b._replace(text=b.text.replace(page_samples.MARK, "").strip() or "-") for b in found]
        rows, same = features(found)
        sequences.append(([sorted(_named(path, near) + said) for path, near, said in rows], same, labels))
    return crf.fit([s for s in sequences if s[0]])


class Reader:
    """Labels the blocks of pages; scores of ancestors are looked up, as pages of a site share them."""

    def __init__(self, model: crf.Model):
        self.model = model
        self._paths: dict[tuple[frozenset[str], frozenset[str]], float] = {}

    def read(self, html: str) -> tuple[list[Block], list[int]]:
        found = blocks(html)
        rows, same = features(found)
        weight = self.model.weights.get
        scores = []
        for path, near, said in rows:
            known = self._paths.get((path, near))
            if known is None:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                known = self._paths[path, near] = sum(weight(f, 0.0) for f in sorted(_named(path, near)))
            scores.append(known + sum(weight(f, 0.0) for f in said))
        return found, crf.viterbi(scores, same, self.model)

    def main_text(self, html: str) -> str:
        found, labels = self.read(html)
        return "\n".join(b.text for b, label in zip(found, labels) if label)


def _reader(model: crf.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            texts: list[str] = []
            start = held = 0
            for k, html in enumerate(batch.column(2)):
                texts.append(reader.main_text(html.as_py() or ""))
                held += len(texts[-1])
                if held > HELD_BYTES or k + 1 == batch.num_rows:
                    done = batch.slice(start, len(texts))
                    sizes = pa.array([len(t) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([done.column(0), done.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])
                    texts, start, held = [], k + 1, 0

    return run


def extract(pages: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_reader(model or trained()), "page_id long, url string, text string, n_chars long")


def labelled_blocks(pages: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """(page_id, nth, tag, text, main) of every leaf block."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for page_id, html in zip(batch.column(0), batch.column(1)):
                found, labels = reader.read(html.as_py() or "")
                key = page_id.as_py()
                rows = [{"page_id": key, "nth": k, "tag": b.tag, "text": b.text, "main": bool(label)} for k, (b, label) in enumerate(zip(found, labels))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("nth", pa.int64()), ("tag", pa.string()), ("text", pa.string()), ("main", pa.bool_())]))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, nth long, tag string, text string, main boolean")
