"""Encoding a corpus with a public byte-level BPE vocabulary by dynamic programming over prefixes.

For each prefix of a pre-token exactly one last token is possible: the token t that ends the prefix such that
the last token of the rest and t are compatible, that is, stay as they are when their bytes are encoded
together. An automaton over the vocabulary lists the tokens ending at each byte, a pair test decides, and
back-pointers from the whole pre-token give the ids. Time is linear in the text; no merges are replayed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pre-token pattern of the public vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of at most this many characters are remembered, so many at a time; both only save time.
MEMO_CHARS, MEMO_WORDS = 48, 200_000
MEMO_PAIRS = 500_000
_OUT_IDS = 2_000_000


def _byte_names() -> dict[str, int]:
    """The byte behind each character of the vocabulary file: printable bytes name themselves, the rest follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    names = {chr(b): b for b in own}
    for i, b in enumerate(x for x in range(256) if x not in set(own)):
        names[chr(256 + i)] = b
    return names


class PrefixEncoder:
    """Token ids of texts; `vocabulary` is the content of a byte-level BPE file with `vocab` and `merges`."""

    def __init__(self, vocabulary: str | bytes):
        import ahocorasick
        import regex

        model = json.loads(vocabulary)["model"]
        vocab = model["vocab"]
        byte = _byte_names()
        raw = lambda t: "".join(chr(byte[c]) for c in t)
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.joined.setdefault((x, y), z)
            self.split.setdefault(z, (x, y))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            # a token that its own parts would not merge into never ends a prefix
            if i not in self.split or self.compatible(*self.split[i], below=i):
                r = raw(t)
                self.automaton.add_word(r, (i, len(r)))
        self.automaton.make_automaton()

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether both tokens stay when encoded together: no merge across their border comes before those inside them.

        Walks the border pair back through both tokens' merges, the later merge first. `below` asks about
        merges before that id only.
        """
        limit = 1 << 60 if below is None else below
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < limit:
                return False
            a = left if left in self.split else -1
            b = right if right in self.split else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                # the left token was made last: just before that, its right part stood at the border
                limit, left = min(limit, a), self.split[left][1]
            else:
                # the left part of the right token; a merge of equal rank further left would have come first
                limit, right = min(limit, b + 1), self.split[right][0]

    def word(self, w: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        text = w.encode("utf-8").decode("latin-1")
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, split = self.pairs, self.compatible
        for end, (t, k) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - k
            if start:
                p = last[start]
                if p < 0:
                    continue
                ok = pairs.get((p, t))
                if ok is None:
                    if len(pairs) >= MEMO_PAIRS:
                        pairs.clear()
                    ok = pairs[p, t] = split(p, t)
                if not ok:
                    continue
            last[end], size[end] = t, k
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for w in self.find(text):
            ids = memo.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[w] = ids
            out += ids
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))


_ENCODERS: dict[int, PrefixEncoder] = {}


def _encoder(vocabulary) -> PrefixEncoder:  # noqa: ANN001
    """One encoder per Python worker and vocabulary."""
    made = _ENCODERS.get(vocabulary.id)
    if made is None:
        _ENCODERS.clear()
        made = _ENCODERS[vocabulary.id] = PrefixEncoder(vocabulary.value)
    return made


class _Vocabulary:
    """A vocabulary file's bytes (1.6 MB; at most MOST) on its way to the workers."""

    MOST = 64_000_000

    def __init__(self, df: DataFrame, path: str):
        with open(path, "rb") as f:
            data = f.read(self.MOST + 1)
        if len(data) > self.MOST:
            raise ValueError(f"{path} is no vocabulary: more than {self.MOST} bytes")
        self._sent = df.sparkSession.sparkContext.broadcast(data)
        self.id = self._sent._jbroadcast.id()

    def __getstate__(self) -> dict:
        return {"sent": self._sent, "id": self.id}

    def __setstate__(self, s: dict) -> None:
        self._sent, self.id = s["sent"], s["id"]

    @property
    def value(self) -> bytes:
        return self._sent.value


def _ids_of(vocabulary: _Vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(vocabulary)
        schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for b in batches:
            keys, offsets, values = [], [0], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                if text:
                    values += e.encode(text)
                keys.append(k)
                offsets.append(len(values))
                if len(values) >= _OUT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], schema=schema)
                    keys, offsets, values = [], [0], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], schema=schema)

    return run


def _sizes_of(vocabulary: _Vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(vocabulary)
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])
        for b in batches:
            sizes = [e.count(t) if (t := x.as_py()) else 0 for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], schema=schema)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids ARRAY<INT>): the token ids of each text, without special tokens.

    Null and empty texts give an empty list, never null; the strings of special tokens are ordinary text. One row
    per input row, repeated ids included; other columns are ignored. No shuffle.
    """
    v = _Vocabulary(docs, vocabulary)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_ids_of(v), "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens): the sizes only; null and empty texts have none."""
    v = _Vocabulary(docs, vocabulary)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sizes_of(v), "id bigint, n bigint").toDF(id_col, "n_tokens")
