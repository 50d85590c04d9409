"""Missing or wrong document language labels by multilingual mixture inference.

A text is a mixture of languages: each of its sentences comes from one language, with n-gram likelihoods of
that language's model. Expectation-maximisation estimates the text's language proportions; the set of languages is
chosen by penalised likelihood, a language staying only if leaving it out costs more than PENALTY. Models are
trained here, on a bounded sample of labelled rows, and refined by relabelling that sample's sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "ru", "zh")
#: What names a language in a label (fixed values): codes of two and three letters, English names.
LABELS = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "castilian"),
    "fr": ("fr", "fra", "fre", "french"),
    "it": ("it", "ita", "italian"),
    "ja": ("ja", "jpn", "japanese"),
    "nl": ("nl", "nld", "dut", "dutch", "flemish"),
    "pt": ("pt", "por", "portuguese"),
    "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "chinese", "mandarin"),
}
#: Bounds of the training sample: rows per language and characters per row. It is the same share of nothing else.
TRAIN_DOCS, TRAIN_CHARS = 400, 5_000
#: Candidates for the sample in multiples of TRAIN_DOCS; where fewer than one in SPARE is short enough, the sample is smaller.
SPARE = 6
BUCKETS_LOG2 = 16
_ORDERS = (1, 2, 3, 4)
#: Nats by which the best language of a sentence must lead, and letters it must have, to be evidence.
LEAD, LETTERS = 5.0, 6
PENALTY = 10.0
#: Expected sentences below which a language is not tried.
LEAST_SENTENCES = 0.5
_ROUNDS = 12
_CHUNK_CHARS = 1_000_000
#: Characters whose n-grams are made at once, and tokens and characters that a task holds scores of.
_GRAM_CHARS, _HELD_TOKENS, _HELD_CHARS = 20_000, 200_000, 4_000_000

#: A word that this many languages use (NEUTRAL_USES times each) names no language: symbols, borrowed terms.
NEUTRAL_LANGUAGES, NEUTRAL_USES = 4, 2


class Model(NamedTuple):
    """What is trained: log probabilities [bucket of n-grams, language] and words that are no evidence."""

    table: np.ndarray
    neutral: frozenset[str]


_END = re.compile(r"""[.!?…]+["'”’»)\]*_]*(?=\s|$)|[。！？]+["'”’」』)）]*|[\r\n  ]+""")
_CODE = re.compile(r"[A-Za-z0-9_./:#-]*[0-9][A-Za-z0-9_./:#-]*")
_NO_LETTER = re.compile(r"(?:(?!\n)[\W\d_])+")
_MARKS = re.compile(r"[̀-゙゚ͯٓ-ٕ]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")


def label_code(label: Column) -> Column:
    """The two-letter code a label names, in any usual spelling (code, code with country, English name); else null."""
    head = F.lower(F.regexp_extract(F.regexp_replace(label, r"^\s+", ""), r"^([A-Za-z]+)(?:[-_][A-Za-z0-9-_]+)?\s*$", 1))
    return F.coalesce(*[F.when(head.isin(*names), F.lit(code)) for code, names in LABELS.items()])


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence or line; white space at both ends left out."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    trimmed = []
    for a, b in out:
        s = text[a:b]
        left = len(s) - len(s.lstrip())
        if left < len(s):
            trimmed.append((a + left, a + len(s.rstrip())))
    return trimmed


def normalised(lines: list[str], neutral: frozenset[str] = frozenset()) -> str:
    """The lines as one text of lower-case letters without accents; neutral words and those of letters and digits go."""
    text = "\n".join(x.replace("\n", " ").replace("\r", " ") for x in lines)
    text = _CODE.sub(" ", text)
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text).casefold())
    text = _NO_LETTER.sub(" ", text)
    if not neutral:
        return text
    return "\n".join(" ".join([w for w in x.split(" ") if w not in neutral]) for x in text.split("\n"))


def _grams(tokens: list[str], neutral: frozenset[str] = frozenset()) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per order (bucket of each n-gram, its token in ascending order), and the letters of each token."""
    text = " " + normalised(tokens, neutral).replace("\n", " \n ") + " "
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    brk = code == 10
    owner = np.cumsum(brk)
    letter = (code != 32) & ~brk
    letters = np.bincount(owner[letter], minlength=len(tokens))
    out = []
    h = np.zeros(len(code), dtype=np.uint64)
    cross = np.zeros(len(code), dtype=bool)
    only_space = np.ones(len(code), dtype=bool)
    for n in range(1, max(_ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(1_000_003) + code[n - 1 :]
        cross = cross[:m] | brk[n - 1 :]
        only_space = only_space[:m] & (code[n - 1 :] == 32)
        if n in _ORDERS:
            keep = ~(cross | only_space)
            x = (h[keep] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append(((x >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), owner[:m][keep]))
    return out, letters


def _chunks(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of tokens small enough for a processor's cache."""
    start = size = 0
    for i, t in enumerate(tokens):
        if size and size + len(t) > _GRAM_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(tokens):
        yield start, len(tokens)


def _line_sums(values: np.ndarray, per_line: np.ndarray) -> np.ndarray:
    """Sums of the tokens' values over each line."""
    out = np.zeros((len(per_line), *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else values.dtype)
    there = np.flatnonzero(per_line)
    if len(there):
        out[there] = np.add.reduceat(values, (np.cumsum(per_line) - per_line)[there], axis=0)
    return out


class Scores:
    """Log-likelihoods of tokens (runs without white space) under a model, each distinct token scored once while it is held.

    n-grams end at white space, so a line's likelihood is the sum of its tokens'. What is held is bounded in tokens and characters.
    """

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.score = np.zeros((0, self.model.table.shape[1]), dtype=np.float32)
        self.letters, self.wide = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _add(self, tokens: list[str]) -> None:
        score = np.zeros((len(tokens), self.score.shape[1]), dtype=np.float32)
        letters = np.zeros(len(tokens), dtype=np.int64)
        for a, b in _chunks(tokens):
            grams, letters[a:b] = _grams(tokens[a:b], self.model.neutral)
            for bucket, owner in grams:
                if len(bucket):
                    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    score[a + owner[firsts]] += np.add.reduceat(self.model.table[bucket], firsts, axis=0)
        # n-grams of all orders overlap: their likelihoods are averaged over the orders
        self.score = np.concatenate([self.score, score / len(_ORDERS)])
        self.letters = np.r_[self.letters, letters]
        self.wide = np.r_[self.wide, np.fromiter((0 if t.isascii() else len(_WIDE.findall(t)) for t in tokens), np.int64, len(tokens))]
        for t in tokens:
            self.number[t] = len(self.number)
            self.chars += len(t)

    def of(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """([line, language] log-likelihood, letters, wide characters and tokens of each line)."""
        if len(self.number) > _HELD_TOKENS or self.chars > _HELD_CHARS:
            self._clear()
        split = [x.split() for x in lines]
        per_line = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        fresh = [t for t in dict.fromkeys(flat) if t not in self.number]
        if fresh:
            self._add(fresh)
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        return _line_sums(self.score[at], per_line), _line_sums(self.letters[at], per_line), _line_sums(self.wide[at], per_line), per_line


def _model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities [bucket, language] from counts, smoothed towards the corpus as a whole."""
    whole = counts.sum(axis=1, keepdims=True) + 0.05
    whole /= whole.sum()
    total = counts.sum(axis=0, keepdims=True)
    strength = 2_000.0
    out = np.log((counts + strength * whole) / (total + strength))
    return out.astype(np.float32)


def likelihoods(model: Model, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """([line, language] log-likelihood of its n-grams per order, letters of each line)."""
    score, letters, _, _ = Scores(model).of(lines)
    return score, letters


def _bucket_counts(tokens: list[str], uses: np.ndarray, neutral: frozenset[str]) -> np.ndarray:
    """[bucket, language] counts of the n-grams of `tokens`, each used `uses` [token, language] times."""
    size, k = 1 << BUCKETS_LOG2, uses.shape[1]
    out = np.zeros((size, k))
    for a, b in _chunks(tokens):
        for bucket, owner in _grams(tokens[a:b], neutral)[0]:
            at, lang = np.nonzero(uses[a:b][owner])
            out += np.bincount(bucket[at] * k + lang, weights=uses[a + owner[at], lang], minlength=size * k).reshape(size, k)
    return out


def _neutral(tokens: list[str], uses: np.ndarray) -> frozenset[str]:
    """Words in sentences of many languages."""
    per: dict[str, np.ndarray] = {}
    for x, n in zip(normalised(tokens).split("\n"), uses):
        for w in x.split():
            per[w] = per[w] + n if w in per else n
    return frozenset(w for w, n in per.items() if (n >= NEUTRAL_USES).sum() >= NEUTRAL_LANGUAGES)


def train(texts: list[str], codes: list[str]) -> Model:
    """The model from labelled texts; two rounds give each sentence the language that the model before finds in it."""
    lines, lang = [], []
    for t, c in zip(texts, codes):
        for a, b in sentences(t):
            lines.append(t[a:b])
            lang.append(LANGUAGES.index(c))
    k = len(LANGUAGES)
    now = label = np.array(lang, dtype=np.int64)
    seen = np.bincount(label, minlength=k) > 0
    split = [x.split() for x in lines]
    per_line = np.fromiter(map(len, split), np.int64, len(split))
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(t, len(number)) for t in chain.from_iterable(split)), np.int64, int(per_line.sum()))
    tokens = list(number)

    def uses(kept: np.ndarray) -> np.ndarray:
        """How often each token occurs in the kept lines of each language."""
        m = np.repeat(kept, per_line)
        return np.bincount(at[m] * k + np.repeat(now, per_line)[m], minlength=len(tokens) * k).reshape(len(tokens), k)

    neutral: frozenset[str] = frozenset()
    kept = np.ones(len(lines), dtype=bool)
    for again in range(3):
        table = _model(_bucket_counts(tokens, uses(kept), neutral))
        table[:, ~seen] = table.min() - 5.0
        if again == 2 or not lines:
            break
        score, letters = likelihoods(Model(table, neutral), lines)
        ranked = np.sort(score, axis=1)
        sure = (ranked[:, -1] - ranked[:, -2] >= LEAD) & (letters >= LETTERS)
        now = np.where(sure, score.argmax(axis=1), label)
        kept = letters >= LETTERS
        neutral = _neutral(tokens, uses(sure))
    return Model(table, neutral)


def mixture(score: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """([document, language] proportions, zero for languages not held; [sentence, language] responsibilities).

    score: log-likelihoods of the sentences that are evidence, doc: their documents in ascending order.
    """
    k = score.shape[1]
    share = np.zeros((n_docs, k))
    if not len(score):
        return share, np.zeros((0, k))
    rel = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -60, 0))
    firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    own = doc[firsts]
    count = np.diff(np.r_[firsts, len(doc)])[:, None]
    share[own] = 1.0 / k
    for _ in range(_ROUNDS):
        r = share[doc] * rel
        r /= r.sum(axis=1, keepdims=True)
        share[own] = np.add.reduceat(r, firsts, axis=0) / count
    # penalised choice of the set, where more than one language is left. Pruning by expected sentences, not by share, loses
    # nothing however long the text: where they sum to less than 0.5, each sentence's responsibility r is below 0.5 and the
    # language gains at most sum(-log(1 - r)) < 0.7 nats, which PENALTY refuses
    maybe = np.zeros((n_docs, k), dtype=bool)
    maybe[own] = share[own] * count >= LEAST_SENTENCES
    maybe[own, share[own].argmax(axis=1)] = True
    several = np.flatnonzero(maybe.sum(axis=1) > 1)
    share[~maybe] = 0.0
    starts = dict(zip(own.tolist(), zip(firsts.tolist(), (firsts + count[:, 0]).tolist())))
    for d in several.tolist():
        a, b = starts[d]
        x = rel[a:b]
        held = [j for j in np.argsort(share[d]) if maybe[d, j]]
        for j in list(held):
            if len(held) == 1:
                break
            rest = [i for i in held if i != j]
            if _fit(x, held) - _fit(x, rest) < PENALTY:
                held = rest
        p = np.zeros(k)
        p[held] = _proportions(x, held)
        share[d] = p
    share[own] /= share[own].sum(axis=1, keepdims=True)
    r = share[doc] * rel + 1e-300
    return share, r / r.sum(axis=1, keepdims=True)


def _proportions(x: np.ndarray, held: list[int]) -> np.ndarray:
    p, y = np.full(len(held), 1.0 / len(held)), x[:, held]
    for _ in range(_ROUNDS):
        p = p * ((1.0 / (y @ p + 1e-300)) @ y) / len(y)
    return p / p.sum()


def _fit(x: np.ndarray, held: list[int]) -> float:
    """Log-likelihood of a document's sentences under the best mixture of the held languages."""
    return float(np.log(x[:, held] @ _proportions(x, held) + 1e-300).sum())


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, codes = [], []
    for b in batches:
        codes += b.column(0).to_pylist()
        texts += b.column(1).to_pylist()
    m = train(texts, codes)
    yield pa.RecordBatch.from_arrays([pa.array([m.table.tobytes()], pa.binary()), pa.array([sorted(m.neutral)], pa.list_(pa.string()))], names=["model", "neutral"])


def _unpack(table: bytes, neutral: list[str]) -> Model:
    return Model(np.frombuffer(table, dtype=np.float32).reshape(-1, len(LANGUAGES)), frozenset(neutral))


def fit_model(docs: DataFrame) -> Model:
    """Trains on at most TRAIN_DOCS labelled rows a language (the smallest by a hash of their id) of at most TRAIN_CHARS characters.

    Labels are counted first, over all rows; the counts give each language a bound on the hash below which about SPARE times
    as many rows lie, so what is shuffled and ranked does not grow with the table or its number of tasks. The sample, at most
    20 MB, is trained in one task; only the model (2.6 MB and the sample's shared words) comes to the driver.
    """
    code = label_code(F.col("lang"))
    counts = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).select(code.alias("code"), "n").where("code is not null").groupBy("code").agg(F.sum("n").alias("n")).collect()
    if not counts:
        return train([], [])
    share = {r.code: min(1.0, SPARE * TRAIN_DOCS / r.n) for r in counts}
    below = F.coalesce(*[F.when(F.col("code") == c, F.lit(min(int((2 * x - 1) * 2**63), 2**63 - 1))) for c, x in sorted(share.items())])
    rows = docs.select(code.alias("code"), "text", F.xxhash64("doc_id").alias("h")).where("code is not null").where(F.col("h") <= below)
    rows = rows.where(F.length("text").between(1, TRAIN_CHARS))
    w = Window.partitionBy("code").orderBy("h", "text")
    rows = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= TRAIN_DOCS).select("code", "text", "h")
    got = rows.coalesce(1).sortWithinPartitions("code", "h", "text").select("code", "text").mapInArrow(_train_task, "model binary, neutral array<string>").collect()
    return _unpack(got[0].model, got[0].neutral) if got else train([], [])


def infer(model: Model | Scores, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, int, float]]], np.ndarray]:
    """(proportions [text, language], segments of each text as (start, end, language, confidence), confidence of each text)."""
    return _infer(model if isinstance(model, Scores) else Scores(model), texts)[:3]


def _infer(scores: Scores, texts: list[str | None]) -> tuple:
    """What `infer` gives, and the most likely language of each text from all its letters: (language or -1, probability)."""
    lines, doc, where = [], [], []
    for i, t in enumerate(texts):
        for a, b in sentences(t) if t else ():
            lines.append(t[a:b])
            doc.append(i)
            where.append((a, b))
    score, letters, wide, words = scores.of(lines)
    at = np.array(doc, dtype=np.int64)
    ranked = np.sort(score, axis=1)
    enough = (letters >= LETTERS) & ((wide >= 4) | (words >= 3))
    evidence = enough & (ranked[:, -1] - ranked[:, -2] >= LEAD)
    share, resp = mixture(score[evidence], at[evidence], len(texts))
    segments: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for j, (i, r) in enumerate(zip(np.flatnonzero(evidence).tolist(), resp)):
        d, (a, b) = doc[i], where[i]
        k = int(r.argmax())
        s = segments[d]
        if s and s[-1][2] == k:
            s[-1] = (s[-1][0], b, k, min(s[-1][3], float(r[k])))
        else:
            s.append((a, b, k, float(r[k])))
    conf = np.zeros(len(texts))
    for d, s in enumerate(segments):
        conf[d] = sum(x[3] for x in s) / len(s) if s else 0.0
    whole, some = np.zeros((len(texts), score.shape[1])), np.zeros(len(texts), dtype=np.int64)
    np.add.at(whole, at, score)
    np.add.at(some, at, letters)
    odds = np.exp(whole - whole.max(axis=1, keepdims=True))
    return share, segments, conf, np.where(some > 0, whole.argmax(axis=1), -1), 1.0 / odds.sum(axis=1)


_SCHEMA = "doc_id bigint, label string, lang string, proportion double, confidence double, segments array<struct<start:int,end:int,lang:string,confidence:double>>"


def _infer_task(sent) -> Callable:  # noqa: ANN001
    segment = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("lang", pa.string()), ("proportion", pa.float64()), ("confidence", pa.float64()), ("segments", pa.list_(segment))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(_unpack(*sent.value))
        for batch in batches:
            at = 0
            long = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and size < _CHUNK_CHARS:
                    size += long[end]
                    end += 1
                b = batch.slice(at, end - at)
                at = end
                ids, labels, texts = (b.column(i).to_pylist() for i in range(3))
                share, segments, conf, likely, odds = _infer(scores, texts)
                rows = []
                for i, (doc, label) in enumerate(zip(ids, labels)):
                    held = np.flatnonzero(share[i] > 0)
                    for k in held[np.argsort(-share[i, held], kind="stable")].tolist():
                        own = [{"start": a, "end": e, "lang": LANGUAGES[j], "confidence": c} for a, e, j, c in segments[i] if j == k]
                        rows.append((doc, label, LANGUAGES[k], float(share[i, k]), float(conf[i]), own))
                    if not len(held):
                        rows.append((doc, label, LANGUAGES[likely[i]], None, float(odds[i]), []) if likely[i] >= 0 else (doc, label, None, None, None, []))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document and language it holds: doc_id, label (its code or null), lang, proportion, confidence, segments.

    proportion is the language's share of the sentences that are evidence; confidence the mean over the document's segments;
    segments are runs of sentences of that language with character offsets. Single foreign terms inside a sentence don't
    count. Documents without any sentence that is evidence have one row with proportion null: its most likely language from
    whatever letters it has, with that language's probability, or lang null without letters (null, blank, numbers only).
    """
    model = fit_model(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(model.table, dtype=np.float32).tobytes(), sorted(model.neutral)))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), label_code(F.col("lang")).alias("label"), "text").mapInArrow(_infer_task(sent), _SCHEMA)


def wrong_labels(found: DataFrame) -> DataFrame:
    """(doc_id, lang): of `identify`'s rows, the languages of documents whose label is missing or wrong or that hold several."""
    return found.where(F.col("proportion").isNotNull() & (F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("proportion") < 1.0))).select("doc_id", "lang")
