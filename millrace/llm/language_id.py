"""Language identification by interpolated Kneser-Ney character models.

For each language an order-4 character model is learned from a bounded sample of labelled documents (SAMPLE of each
language, chosen by a hash of the id). N-gram counts are summed by Spark; discounts, continuation counts and
interpolated probabilities are worked out once, and kept as arrays of 64-bit n-gram hashes in ascending order with a
column of log probabilities for each language. Every document is scored whole; the language with the lowest
cross-entropy per character wins, ties to the first by name. Documents whose cross-entropy lies far beyond that of
calibration documents of the same language, for their length, are rejected.

Text is lower-cased; what is not a letter counts as one space. Texts over PIECE characters are scored and counted in
pieces that go on with the last symbols of the piece before, so the sums are those of the whole text.

A document is rejected if its excess over its language's mean is more than MARGIN plus TIMES the QUANTILE of what
calibration documents show, for its length: one odd calibration document doesn't widen the limit for all. A language without a calibration document is calibrated by up to 2 * CALIBRATE of its counted ones, each scored by a
model of the others.

Defined cases: a text that is null or has no letters gets `und`, score 0, and is rejected; without labelled documents
every text gets that; repeated rows get equal results; an empty table gives no rows; other columns of the input are
ignored. The number of languages is small (the tables have a column for each).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import dropped, small_batches, stored

ORDER = 4
#: Labelled documents of each language that are learned from, calibration included.
SAMPLE = 800
#: Every CALIBRATE-th sampled document calibrates and isn't counted.
CALIBRATE = 5
#: Characters scored at once, and characters counted at once.
PIECE = 100_000
COUNTED = 400_000
#: Rejected: an excess of cross-entropy of more than this (nats a character) plus TIMES the QUANTILE of those that
#: calibration shows, which shrinks with the square root of the length.
MARGIN = 1.0
TIMES = 3.0
QUANTILE = 0.95
UNDETERMINED = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


#: What leads a text: nothing before its first word.
_START = "\0" * (ORDER - 1) + " "


def symbols(texts: list[str], before: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts (lower case) in a row, the text of each, and which are to be scored.

    Each text is led by ORDER symbols that aren't scored: zeros and a space, or for a piece that goes on with a text
    the last symbols before it. Runs of what is no letter are one space.
    """
    low = [lead + text for lead, text in zip(before or [_START] * len(texts), texts)]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(x) for x in low])
    start = np.cumsum([0] + [len(x) for x in low])[:-1]
    leading = (start[:, None] + np.arange(ORDER)).ravel()
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[leading] = True
    scored = np.ones(len(code), bool)
    scored[leading] = False
    code = np.where(letter | (code == 0), code, np.uint32(_SPACE))
    code[np.flatnonzero(scored & (code == 0))] = _SPACE
    return code[keep], owner[keep], scored[keep]


def _lead(text: str, at: int) -> str:
    """The ORDER symbols before a place in a text (lower case)."""
    reach = 64
    while True:
        code, _, scored = symbols([text[max(0, at - reach) : at]])
        last = code[scored]
        if reach >= at:
            return (_START + "".join(map(chr, last)))[-ORDER:]
        if len(last) > ORDER:  # the first one may be the rest of a longer run
            return "".join(map(chr, last[-ORDER:]))
        reach *= 4


def pieces(text: str) -> Iterator[tuple[str, str]]:
    """(symbols before, piece) of a text, in lower case, of at most PIECE characters."""
    text = text.lower()
    for at in range(0, len(text), PIECE):
        yield (_lead(text, at) if at else _START), text[at : at + PIECE]


def gram_hashes(code: np.ndarray) -> list[np.ndarray]:
    """For n from 1 to ORDER: the hash of the n symbols that end at each place."""
    with np.errstate(over="ignore"):
        one = (code.astype(np.uint64) + np.uint64(1)) * _STEP
        one ^= one >> np.uint64(29)
        one *= np.uint64(0xBF58476D1CE4E5B9)
        out = [one]
        for _ in range(ORDER - 1):
            h = one.copy()
            h[1:] += out[-1][:-1] * _STEP
            out.append(h ^ (h >> np.uint64(31)))
    return out


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted hash in ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


@dataclass
class Model:
    """languages; per order n (index n - 1): hashes of n-grams and their log probabilities by language, hashes of
    contexts of n - 1 symbols and their log back-off weights by language."""

    languages: list[str]
    base: np.ndarray
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sharpness: float = 1.0

    def log_probabilities(self, hashes: list[np.ndarray], at: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the symbols at these places, a column for each language."""
        if not order:
            return np.broadcast_to(self.base, (len(at), len(self.languages)))
        place, there = _look_up(self.grams[order - 1], hashes[order - 1][at])
        out = self.logs[order - 1][place]
        if not there.all():
            rest = at[~there]
            lower = self.log_probabilities(hashes, rest, order - 1)
            if order > 1:
                context, known = _look_up(self.contexts[order - 1], hashes[order - 2][rest - 1])
                lower = lower + np.where(known[:, None], self.weights[order - 1][context], np.float32(0))
            else:
                lower = lower + self.weights[0][0]
            out[~there] = lower
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored of each text, and nats a character by language."""
        n = np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        rest = [(i, *p) for i, text in enumerate(texts) for p in pieces(text)]
        while rest:
            size = np.cumsum([len(p) for _, _, p in rest])
            take = max(1, int(np.searchsorted(size, PIECE, "right")))
            part, rest = rest[:take], rest[take:]
            code, owner, scored = symbols([p for _, _, p in part], [lead for _, lead, _ in part])
            at = np.flatnonzero(scored)
            if not len(at):
                continue
            logs = self.log_probabilities(gram_hashes(code), at).astype(np.float64)
            whose = np.array([i for i, _, _ in part])[owner[at]]
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            total[whose[first]] -= np.add.reduceat(logs, first, axis=0)
            n += np.bincount(whose, minlength=len(texts))
        return n, total / np.maximum(n, 1)[:, None]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        n, entropy = self.cross_entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp(-self.sharpness * (entropy - low[:, None])).sum(axis=1)
        limit = MARGIN + TIMES * self.spread[best] / np.sqrt(np.maximum(n, 1))
        known = n > 0
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
        return names, np.where(known, score, 0.0), known & (low - self.mean[best] <= limit)


def learnable(id_col: str = "doc_id", lang_col: str = "lang") -> Column:
    """Rows that may be learned from: a known language and an id outside the held-out third."""
    return F.col(lang_col).isNotNull() & ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def sample_rows(labelled: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """At most per_language different rows of each language, by a hash of id and text; columns text, lang, calibrate."""
    row = ("lang", "doc_id", F.xxhash64("text").alias("digest"))
    sizes = labelled.select(*row).distinct().groupBy("lang").count().collect()
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.lit(0)
    for r in sizes:
        if r["lang"] is not None:
            most = (1 << 30) if r["count"] <= per_language else int((1 << 30) * per_language / r["count"])
            share = F.when(F.col("lang") == r["lang"], most).otherwise(share)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("spread", "doc_id", "digest"))
    return (
        labelled.where(spread < share)
        .groupBy(*row, spread.alias("spread"))
        .agg(F.get(F.collect_set("text"), F.lit(0)).alias("text"))  # by hash: a sort's pages in each of many tasks add up
        .withColumn("nth", nth)
        .where(F.col("nth") <= per_language)
        .select("text", "lang", (F.col("nth") % CALIBRATE == 0).alias("calibrate"))
    )


def _gram_batches(texts: list[str], langs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """lang, n, gram, context, lower, count of the texts' n-grams, in bounded runs of characters."""
    for lang in sorted(set(langs)):
        own = [p for t, x in zip(texts, langs) if x == lang for p in pieces(t)]
        while own:
            size = np.cumsum([len(p) for _, p in own])
            take = max(1, int(np.searchsorted(size, COUNTED, "right")))
            part, own = own[:take], own[take:]
            code, _, scored = symbols([p for _, p in part], [lead for lead, _ in part])
            at = np.flatnonzero(scored)
            hashes = gram_hashes(code)
            for n in range(1, ORDER + 1):
                gram, first, count = np.unique(hashes[n - 1][at], return_index=True, return_counts=True)
                context = hashes[n - 2][at[first] - 1] if n > 1 else np.zeros(len(gram), np.uint64)
                lower = hashes[n - 2][at[first]] if n > 1 else np.zeros(len(gram), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(gram), pa.string()),
                        pa.array(np.full(len(gram), n, np.int32)),
                        *(pa.array(x.view(np.int64)) for x in (gram, context, lower)),
                        pa.array(count.astype(np.int64)),
                    ],
                    ["lang", "n", "gram", "context", "lower", "count"],
                )


def _counts(rows: DataFrame) -> DataFrame:
    """lang, n, gram, context, lower, count: of each n-gram its hash, that of its first n - 1 symbols, that of its
    last n - 1 ones, and how often it occurs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _gram_batches(batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object))

    per_batch = rows.select("text", "lang").mapInArrow(
        task, "lang string, n int, gram bigint, context bigint, lower bigint, count bigint"
    )
    return per_batch.groupBy("lang", "n", "gram").agg(
        F.first("context").alias("context"), F.first("lower").alias("lower"), F.sum("count").alias("count")
    )


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, values, len(unique))


def build(counts: pa.Table) -> Model:
    """Kneser-Ney models from n-gram counts."""
    languages = sorted(set(counts.column("lang").to_pylist()))
    lang = np.array(counts.column("lang").to_pylist(), object)
    n = counts.column("n").to_numpy()
    gram, context, lower = (counts.column(c).to_numpy().view(np.uint64) for c in ("gram", "context", "lower"))
    count = counts.column("count").to_numpy().astype(np.float64)
    size = len(np.unique(gram[n == 1])) + 1
    base = np.full(len(languages), -np.log(size), np.float32)
    model = Model(languages, base, [], [], [], [])
    for order in range(1, ORDER + 1):
        here, above = n == order, n == order + 1
        keys, first = np.unique(gram[here], return_index=True)
        its_context, its_lower = context[here][first], lower[here][first]
        contexts = np.unique(its_context)
        logs = np.empty((len(keys), len(languages)), np.float32)
        weights = np.zeros((len(contexts), len(languages)), np.float32)
        for k, name in enumerate(languages):
            own = here & (lang == name)
            times = np.zeros(len(keys))
            if order == ORDER:
                times[np.searchsorted(keys, gram[own])] = count[own]
            else:  # continuation counts: of the distinct symbols that come before
                ends, before = _sums(lower[above & (lang == name)], np.ones((above & (lang == name)).sum()))
                place, there = _look_up(keys, ends)
                times[place[there]] = before[there]
            once, twice = (times == 1).sum(), (times == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            seen = times > 0
            of = np.searchsorted(contexts, its_context)
            total = np.bincount(of, times, len(contexts))
            kinds = np.bincount(of, seen, len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(total > 0, discount * kinds / total, 1.0)
                if order == 1:
                    below = np.exp(base[k].astype(np.float64))
                else:
                    below = np.exp(_lower_logs(model, its_lower, its_context, k, order))
                p = np.where(total[of] > 0, np.maximum(times - discount, 0) / np.maximum(total[of], 1), 0)
                logs[:, k] = np.log(p + weight[of] * below)
                weights[:, k] = np.log(np.maximum(weight, 1e-12))
        model.grams.append(keys)
        model.logs.append(logs)
        model.contexts.append(contexts)
        model.weights.append(weights)
    return model


def _lower_logs(model: Model, its_lower: np.ndarray, its_context: np.ndarray, k: int, order: int) -> np.ndarray:
    """Log probability of each n-gram's last n - 1 symbols: those n-grams were counted too."""
    place, there = _look_up(model.grams[order - 2], its_lower)
    return np.where(there, model.logs[order - 2][place, k].astype(np.float64), model.base[k].astype(np.float64))


def calibrate(model: Model, texts: list[str], langs: list[str]) -> None:
    """Means and spreads of the cross-entropy under a document's own language, and the score's sharpness."""
    k = len(model.languages)
    model.mean, model.spread = np.zeros(k), np.full(k, 5.0)
    own = np.array([model.languages.index(x) if x in model.languages else -1 for x in langs], int)
    n, entropy = model.cross_entropies(texts)
    use = (own >= 0) & (n > 0)
    own, n, entropy = own[use], n[use], entropy[use]
    if not len(own):
        return
    mine = entropy[np.arange(len(own)), own]
    for i in range(k):
        if (own == i).any():
            w, e = n[own == i], mine[own == i]
            model.mean[i] = (w * e).sum() / w.sum()
            model.spread[i] = max(5.0, np.quantile((e - model.mean[i]) * np.sqrt(w), QUANTILE))

    def likelihood(sharpness: float) -> float:
        z = -sharpness * (entropy - mine[:, None])
        return -np.log(np.exp(np.minimum(z, 500)).sum(axis=1)).sum()

    model.sharpness = max((2.0**i for i in range(-2, 7)), key=likelihood)


def cross_calibrate(model: Model, language: str, texts: list[str]) -> None:
    """Mean and spread of a language without calibration documents, from its counted ones: each is scored by a model
    of the others, a single one's halves by one of the other half."""
    texts = [t for t in texts if any(c.isalpha() for c in t)]
    if len(texts) == 1:
        half = len(texts[0]) // 2
        texts = [t for t in (texts[0][:half], texts[0][half:]) if any(c.isalpha() for c in t)]
    n, entropy = [], []
    for i, text in enumerate(texts):
        rest = texts[:i] + texts[i + 1 :]
        if rest:
            batches = pa.Table.from_batches(_gram_batches(rest, np.array([language] * len(rest), object)))
            sums = [("context", "min"), ("lower", "min"), ("count", "sum")]
            counts = batches.group_by(["lang", "n", "gram"]).aggregate(sums)
            counts = pa.table({c: counts.column(f"{c}_{f}" if f else c) for c, f in [("lang", ""), ("n", ""), ("gram", ""), *sums]})
            chars, nats = build(counts).cross_entropies([text])
            n.append(chars[0])
            entropy.append(nats[0, 0])
    k = model.languages.index(language)
    if n:
        w, e = np.array(n), np.array(entropy)
        model.mean[k] = (w * e).sum() / w.sum()
        model.spread[k] = max(5.0, ((e - model.mean[k]) * np.sqrt(w)).max())
    else:  # a single letter: no more is known than that no text is likely
        model.mean[k] = -model.base[k]


def learn(labelled: DataFrame, per_language: int = SAMPLE) -> Model:
    """A calibrated model from rows with doc_id, text, lang (rows without text or language don't count)."""
    labelled = labelled.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = stored(sample_rows(labelled, per_language), "language-sample")
    counts = _counts(rows.where(~F.col("calibrate"))).toArrow()
    if not counts.num_rows:
        return Model([], np.zeros(0), [], [], [], [])
    model = build(counts)
    tests = rows.where("calibrate").toArrow()
    calibrate(model, tests.column("text").to_pylist(), tests.column("lang").to_pylist())
    for k in np.flatnonzero(model.mean == 0):
        own = rows.where((F.col("lang") == model.languages[k]) & ~F.col("calibrate"))
        some = own.where(F.col("text").rlike(r"\p{L}")).orderBy(F.xxhash64("text"), "text").limit(2 * CALIBRATE)
        cross_calibrate(model, model.languages[k], [r["text"] for r in some.select("text").collect()])
    dropped(rows.sparkSession, rows)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted of each document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _judged(source, model, ["doc_id"])


def _judged(source: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of source (which ends with text), with lang_pred, score, accepted."""
    shared = source.sparkSession.sparkContext.broadcast(model)
    source = source.select(*keep, "text")
    names = [*keep, "lang_pred", "score", "accepted"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                langs, score, accepted = shared.value.judge(texts)
                found = [pa.array(langs, pa.string()), pa.array(score), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], names)

    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(task, f"{kept}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents (all columns) that the model doesn't reject; rows are judged where they lie, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                good = shared.value.judge([t or "" for t in batch.column(at).to_pylist()])[2]
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(task, docs.schema)


# ---- query ----


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(learnable()))
    source = docs.select("doc_id", held_out().alias("held_out"), "text")
    return _judged(source, model, ["doc_id", "held_out"])
