"""Byte-level BPE by a deterministic tokenization automaton.

The automaton reads tokens.  It starts as one state with an arc for every byte; the merges are then applied in order of rank,
each as a gadget: merging (u, v) into w gives every state that can read u then v an arc w to where v led, and gives the state
behind u a copy without the arc v.  The accepted token strings are exactly the results of BPE, one for every byte string.

All arcs with one label lead to one state, so a state is named by the token read last.  Written out, its arcs would be tens
of millions; instead the gadgets are kept by token (parts and rank) and the transition table is filled with the arcs that
texts use.  Whether state p has arc z follows from the gadgets:
* merge (p, z), once applied, has removed z from p;
* if z is newer than p: p got z exactly if it could read z's left part just after that gadget;
* if p is newer than z: p was copied from the state of its right part just before.

A pre-split word is encoded by the only accepted path over it, found byte by byte from a table of last arcs; decoding emits
the labels of the arcs.  Null texts count as empty, an empty text has no tokens and decodes to an empty text, other columns play no
part, repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROWS = 256  # texts worked on at a time
KNOWN_WORDS = 150_000  # encoded words a worker remembers before it starts anew
KNOWN_ARCS = 300_000
KNOWN_PREFIXES = 300_000
SHORT = 24  # bytes of a word up to which its prefixes are remembered


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Automaton:
    """Tokenization automaton of a byte-level BPE file of the tokenizers library."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        vocabulary: dict[str, int] = model["vocab"]
        self.labels = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, k in vocabulary.items():
            self.labels[k] = bytes(to_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with stripping or word limits are not supported")
        for content, k in self.special.items():
            self.labels[k] = content.encode()
        n = len(self.labels)
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n
        self.removed: dict[int, int] = {}  # p << 20 | z -> rank of the gadget that took arc z from state p
        for k, merge in enumerate(model["merges"]):
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            w = vocabulary[u + v]
            if self.rank[w] >= 0:
                raise ValueError(f"two merges make {u + v!r}")
            self.left[w], self.right[w], self.rank[w] = vocabulary[u], vocabulary[v], k
            self.removed[vocabulary[u] << 20 | vocabulary[v]] = k
        made = [k for k in vocabulary.values() if self.rank[k] >= 0 or len(self.labels[k]) == 1]  # no merge makes the others
        self.ids = {self.labels[k]: k for k in made}
        self.longest = max(map(len, self.ids))
        self.known: dict[bytes, int] = {}
        self.arcs: dict[int, bool] = {}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(SPLIT)

    def has_arc(self, p: int, z: int) -> bool:
        """Whether token z may follow token p."""
        key = p << 20 | z
        known = self.arcs.get(key)
        if known is not None:
            return known
        left, right, rank, removed = self.left, self.right, self.rank, self.removed
        before = len(rank) + 1
        answer = True
        while True:
            gone = removed.get(p << 20 | z)
            if gone is not None and gone < before:
                answer = False
                break
            newer_p, newer_z = rank[p], rank[z]
            if newer_p < 0 and newer_z < 0:
                break
            if newer_z >= newer_p:
                z, before = left[z], newer_z + 1
            else:
                p, before = right[p], newer_p
        if len(self.arcs) >= KNOWN_ARCS:
            self.arcs.clear()
        self.arcs[key] = answer
        return answer

    def encode_word(self, word: bytes) -> list[int]:
        """Labels of the accepted path over one pre-split word.

        A prefix of an accepted path is accepted, so every prefix of the word has exactly one path; only the label of its
        last arc is kept.  It is the one label that ends there and has an arc from the path of what precedes it.
        """
        last = self._last_by_prefix(word) if len(word) <= SHORT else self._last_by_place(word)
        path, at, labels = [], len(word), self.labels
        while at:
            path.append(last[at])
            at -= len(labels[last[at]])
        path.reverse()
        return path

    def _last_by_prefix(self, word: bytes) -> list[int]:
        """Last labels of all prefixes; prefixes met before are looked up."""
        known, ids, arcs = self.known, self.ids, self.arcs
        if len(known) > KNOWN_PREFIXES:
            known.clear()
        last = [-1]
        for end in range(1, len(word) + 1):
            prefix = word[:end]
            found = known.get(prefix)
            if found is None:
                for start in range(end - 1, 0, -1):
                    z = ids.get(prefix[start:])
                    if z is not None:
                        open_ = arcs.get(last[start] << 20 | z)
                        if open_ or open_ is None and self.has_arc(last[start], z):
                            found = z
                            break
                else:
                    found = ids[prefix]
                known[prefix] = found
            last.append(found)
        return last

    def _last_by_place(self, word: bytes) -> list[int]:
        last, ids, longest = [-1], self.ids, self.longest
        for end in range(1, len(word) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                z = ids.get(word[start:end])
                if z is not None and (start == 0 or self.has_arc(last[start], z)):
                    break
            last.append(z)
        return last


class _Words(dict):
    """Encoded words, by text."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        ids = array("I", self.automaton.encode_word(word.encode())).tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids


_workers: dict[str, tuple[Automaton, _Words]] = {}


def _compiled(source: str) -> tuple[Automaton, _Words]:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _workers:
        automaton = Automaton(source)
        _workers[key] = (automaton, _Words(automaton))
    return _workers[key]


def encode_text(automaton: Automaton, words: _Words, text: str | None) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if not isinstance(text, str) or not text:
        return b""
    if automaton.special_re is None or not automaton.special_re.search(text):
        return b"".join(map(words.__getitem__, automaton.split.findall(text)))
    out, at = [], 0
    for m in automaton.special_re.finditer(text):
        out += map(words.__getitem__, automaton.split.findall(text[at : m.start()]))
        out.append(np.array([automaton.special[m[0]]], "<u4").tobytes())
        at = m.end()
    return b"".join([*out, *map(words.__getitem__, automaton.split.findall(text[at:]))])


def decode_ids(automaton: Automaton, ids: bytes) -> bytes:
    """Labels of the arcs, joined."""
    labels = automaton.labels
    return b"".join([labels[k] for k in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>[, decoded string]) per row; ``path``: tokenizer file, read on the driver only."""
    source = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words = _compiled(source.value)
        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                codes = [encode_text(automaton, words, t) for t in batch.column("text").to_pylist()]
                sizes = np.array([len(c) // 4 for c in codes], np.int64)
                values = pa.array(np.frombuffer(b"".join(codes), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)
                out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes), "ids": ids}
                if decoded:
                    out["decoded"] = pa.array([decode_ids(automaton, c).decode("utf-8", "replace") for c in codes], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decoded)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them."""
    source = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, words = _compiled(source.value)
        for whole in batches:
            for batch in (whole.iloc[k : k + ROWS] for k in range(0, len(whole), ROWS)):
                codes = [encode_text(automaton, words, t) for t in batch["text"]]
                texts = [decode_ids(automaton, c).decode("utf-8", "replace").encode() for c in codes]
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"],
                        "n_tokens": [len(c) // 4 for c in codes],
                        "ids_sha256": [hashlib.sha256(c).hexdigest() for c in codes],
                        "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                    }
                ).astype({"doc_id": "Int64"})

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
