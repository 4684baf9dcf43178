"""Byte-level BPE encoding and decoding with tree concatenation.

Texts are split by the tokenizer's own pattern, then merged by rank. A text of
over ``PIECE`` characters is cut into pieces that tasks encode in parallel; a
run that the pattern cannot split (letters, digits, signs or white space only)
and that is longer than ``LEAF`` bytes is cut in halves too. Halves are joined
in a tree. At a join inside such a run a window of tokens around it is encoded
anew, growing until its first token equals the left side's token there and its
last the right side's. Then every neighbouring pair of tokens is one that BPE
produces, which makes the joined sequence the encoding of the whole run.

Cuts fall where the pattern must split whatever stands around (before white
space, between letters and digits, before a sign), else inside a run at least
``MARGIN`` equal-class characters from its ends, never inside a special token.

Defined results: null is empty, an empty text has no tokens; repeated rows get
equal results; an empty table gives an empty result; columns other than those
named are never read. Special tokens found in a text become their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, row_keys, stored

PIECE = 1 << 16      # characters
LEAF = 1 << 9        # bytes
MARGIN = 8
# fixed values: the split pattern of this tokenizer family, and its white space
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
LONG = re.compile(r"\S{%d}|\s{%d}" % (LEAF, LEAF))
RUN = regex.compile(r"\p{L}{%d,}|\p{N}{%d,}|[^\s\p{L}\p{N}]{%d,}|\s{%d,}" % ((LEAF,) * 4))


class Vocabulary:
    """Ranks and special tokens of a byte-level ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items()
                     if k not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ids = [self.rank[bytes(byte[c] for c in "".join(m))] for m in pairs]
        if ids != sorted(ids):
            raise ValueError("the merges of this tokenizer are not in the order of its ids")
        self.token = {v: k for k, v in self.rank.items()} | {v: k.encode() for k, v in self.special.items()}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=self.rank,
                                      special_tokens=self.special)

    def bytes_of(self, ids) -> bytes:
        return b"".join(self.token[i] for i in ids)

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of one unsplit run: lowest rank first, leftmost first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        right = list(range(1, len(parts))) + [-1]
        left = list(range(-1, len(parts) - 1))
        heap = [(r, i) for i in range(len(parts) - 1)
                if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = right[i]
            if parts[i] is None or j < 0 or self.rank.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                n = self.rank.get(parts[i] + parts[right[i]])
                if n is not None:
                    heappush(heap, (n, i))
            if left[i] >= 0:
                n = self.rank.get(parts[left[i]] + parts[i])
                if n is not None:
                    heappush(heap, (n, left[i]))
        return [self.rank[p] for p in parts if p is not None]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of a run from the encodings of its two parts."""
        w = 4
        while True:
            i, j = max(0, len(a) - w), min(len(b), w)
            mid = self.merge(self.bytes_of(a[i:] + b[:j]))
            if (i == 0 or mid[0] == a[i]) and (j == len(b) or mid[-1] == b[j - 1]):
                return a[:i] + mid + b[j:]
            w *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        m = len(data) // 2
        return self.join(self.tree(data[:m]), self.tree(data[m:]))

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        if not LONG.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        out, at = [], 0
        for m in RUN.finditer(text):
            # the run's inside is one unsplit stretch; its ends stay with the text around
            s, e = m.start() + MARGIN, m.end() - MARGIN
            if len({_kind(c) for c in text[s:e]}) > 1 or any(t in text[s - MARGIN:e + MARGIN] for t in self.special):
                continue
            out.append((at, s))
            out.append((s, e))
            at = e
        parts = [Part(self, text[x:y], inside=k % 2 == 1) for k, (x, y) in enumerate(out)]
        parts.append(Part(self, text[at:], inside=False))
        done = parts[0]
        for p in parts[1:]:
            done = done + p
        return np.array(done.ids, np.uint32)


def _kind(ch: str) -> str:
    """Class of a character for the pattern: L, N, S (white space) or O."""
    if ch.isspace():
        return "O" if "\x1c" <= ch <= "\x1f" else "S"
    c = unicodedata.category(ch)[0]
    return c if c in "LN" else "O"


class Part:
    """An encoded stretch of text with the tokens of the unsplit runs that reach
    over its ends: ``head`` leading and ``tail`` trailing tokens."""

    def __init__(self, v: Vocabulary, text: str | None, inside: bool, ids=None, head=0, tail=0):
        self.v = v
        if text is None:
            self.ids, self.head, self.tail = ids, head, tail
        elif inside:
            self.ids = v.tree(text.encode())
            self.head = self.tail = len(self.ids)
        else:
            self.ids = v.fast.encode(text, allowed_special="all")
            self.head, self.tail = self._run(text, 1), self._run(text, -1)

    def _run(self, text: str, step: int) -> int:
        """Tokens of the first (last) pre-token; special tokens stand alone."""
        for t in self.v.special:
            text = text.split(t, 1)[0] if step > 0 else text.rsplit(t, 1)[-1]
        edge = None
        for edge in SPLIT.finditer(text):
            if step > 0:
                break
        size, k = len(edge.group().encode()) if edge else 0, 0
        for i in (self.ids if step > 0 else reversed(self.ids)):
            if size <= 0:
                break
            size -= len(self.v.token[i])
            k += 1
        return k

    def __add__(self, o: Part) -> Part:
        if not self.tail or not o.head:
            return Part(self.v, None, False, self.ids + o.ids, self.head if self.ids else o.head,
                        o.tail if o.ids else self.tail)
        a, b = self.ids[len(self.ids) - self.tail:], o.ids[:o.head]
        mid = self.v.join(a, b)
        ids = self.ids[:len(self.ids) - self.tail] + mid + o.ids[o.head:]
        return Part(self.v, None, False, ids, len(mid) if self.head == len(self.ids) else self.head,
                    len(mid) if o.tail == len(o.ids) else o.tail)


def cuts(text: str, size: int, special) -> list[tuple[int, bool]]:
    """``(position, inside a run)`` of cuts about every ``size`` characters."""
    out, at, last = [], size, 0
    while at < len(text):
        low = max(last + 2 * MARGIN, at - size // 2)
        p = inside = None
        for q in range(at, low, -1):
            x, y = _kind(text[q - 1]), _kind(text[q])
            if x != "S" and y != x and (y == "S" or x in "LN"):
                p, inside = q, False
                break
        else:
            for q in range(at, low, -MARGIN):
                if len({_kind(c) for c in text[q - MARGIN:q + MARGIN]}) == 1 and q + MARGIN <= len(text):
                    p, inside = q, True
                    break
        if p is None:
            at += MARGIN
            continue
        for t in special:
            s = text.find(t, max(0, p - len(t) + 1), p + len(t) - 1)
            if last < s < p < s + len(t):
                p, inside = s, False
        out.append((p, inside))
        last, at = p, p + size
    return out


_KEPT: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    if path not in _KEPT:
        _KEPT[path] = Vocabulary(path)
    return _KEPT[path]


PIECES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("parts", pa.int32()),
                    ("text", pa.string()), ("a", pa.bool_()), ("b", pa.bool_())])
PARTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("parts", pa.int32()),
                   ("ids", pa.list_(pa.int32())), ("head", pa.int32()), ("tail", pa.int32())])


def _long_ids(docs: DataFrame, path: str, piece: int) -> DataFrame:
    """``(k1, k2, ids)`` of ``docs(k1, k2, text)``: pieces encoded apart, then
    joined pairwise, round by round."""
    def split(batches):
        special = _vocabulary(path).special
        for b in batches:
            for r in b.to_pylist():
                at, cut = 0, [*cuts(r["text"], piece, special), (len(r["text"]), False)]
                inside = False
                for n, (p, to) in enumerate(cut):
                    yield pa.RecordBatch.from_pylist([{"k1": r["k1"], "k2": r["k2"], "n": n, "parts": len(cut),
                                                       "text": r["text"][at:p], "a": inside, "b": to}], PIECES)
                    at, inside = p, to

    def encode(batches):
        v = _vocabulary(path)
        for b in batches:
            for r in b.to_pylist():
                t = r["text"]
                if r["a"] and r["b"] and len({_kind(c) for c in t}) == 1:
                    p = Part(v, t, inside=True)
                else:
                    e = Part(v, "", inside=False)
                    e.ids = v.encode(t).tolist()
                    e.head = e._run(t, 1) if r["a"] else 0
                    e.tail = e._run(t, -1) if r["b"] else 0
                    p = e
                yield pa.RecordBatch.from_pylist([{"k1": r["k1"], "k2": r["k2"], "n": r["n"], "parts": r["parts"],
                                                   "ids": p.ids, "head": p.head, "tail": p.tail}], PARTS)

    def join(batches):
        v = _vocabulary(path)
        for b in batches:
            for r in b.to_pylist():
                got = sorted(r["two"], key=lambda x: x["n"])
                p = Part(v, None, False, got[0]["ids"], got[0]["head"], got[0]["tail"])
                for x in got[1:]:
                    p = p + Part(v, None, False, x["ids"], x["head"], x["tail"])
                yield pa.RecordBatch.from_pylist([{"k1": r["k1"], "k2": r["k2"], "n": r["n"], "parts": r["parts"],
                                                   "ids": p.ids, "head": p.head, "tail": p.tail}], PARTS)

    n = partitions(docs.sparkSession)
    pieces = docs.mapInArrow(split, "k1 long, k2 long, n int, parts int, text string, a boolean, b boolean")
    coded = "k1 long, k2 long, n int, parts int, ids array<int>, head int, tail int"
    e = stored(pieces.repartition(n, "k1", "k2", "n").mapInArrow(encode, coded), "bpe-parts")
    left = e.agg(F.max("parts")).first()[0] or 1
    while left > 1:
        e = e.groupBy("k1", "k2", F.floor(F.col("n") / 2).cast("int").alias("n"), "parts") \
            .agg(F.collect_list(F.struct("n", "ids", "head", "tail")).alias("two")).mapInArrow(join, coded)
        left = -(-left // 2)
    return e.select("k1", "k2", "ids")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     piece: int = PIECE, digest: bool = False) -> DataFrame:
    """``(doc_id, k1, k2, ids)`` per row, ids as array<int>; ``digest`` gives
    counts and hashes of the ids and of the decoded text in their place."""
    kind = docs.schema[id_col].dataType.simpleString()
    k1, k2 = row_keys(text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    cols = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"

    def finish(first, ids):
        names = ["doc_id", "k1", "k2"]
        if not digest:
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays([*first, pa.ListArray.from_arrays(
                pa.array(off), pa.array(flat.astype(np.int32)))], [*names, "ids"])
        v = _vocabulary(path)
        return pa.RecordBatch.from_arrays(
            [*first, pa.array([len(x) for x in ids], pa.int64()),
             pa.array([hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest() for x in ids], pa.string()),
             pa.array([hashlib.sha256(decode(v, x).encode()).hexdigest() for x in ids], pa.string())],
            [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    def short(batches):
        v = _vocabulary(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                yield finish(s.columns[:3], [v.encode(t) for t in s.column(3).to_pylist()])

    def long(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = b.slice(i, 1)
                yield finish(s.columns[:3], [np.asarray(s.column(3)[0].as_py(), np.uint32)])

    schema = f"doc_id {kind}, k1 long, k2 long, {cols}"
    size = F.length("text")
    done = base.where(size <= piece).mapInArrow(short, schema)
    rest = base.where(size > piece)
    one = rest.dropDuplicates(["k1", "k2"]).select("k1", "k2", "text")       # copies are encoded once
    ids = _long_ids(one, path, piece)
    joined = rest.select("doc_id", "k1", "k2").join(ids, ["k1", "k2"]).select("doc_id", "k1", "k2", "ids")
    return done.union(joined.mapInArrow(long, schema))


def decode(v: Vocabulary, ids) -> str:
    return v.fast.decode_bytes(ids.tolist() if hasattr(ids, "tolist") else ids).decode("utf-8", "replace")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text`` decoded from the token ids; null ids are
    empty."""
    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        v = _vocabulary(path)
        return pa.array([decode(v, x.values.to_numpy()) if x.is_valid else "" for x in ids], pa.string())

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"),
                          text_of(F.col(ids_col)).alias("text"))
