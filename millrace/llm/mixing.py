"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells (source, language, topic) of tokens. The cells' tokens are raked until their sums by
each of the three agree with the targets; a document is then sampled with the ratio of its cell's raked tokens to the
tokens that are there. Sampling is by a hash of the id, so it is repeatable.

Targets that are powers of what is there share a budget: SHARE of all tokens, whatever the corpus. A cell can't give
more than it has, so raking stops at its tokens (probability 1) and goes on with the others, and the result is scaled
to the budget; a scarce cell bends the targets by what it lacks and no more. Targets that are given as shares are met
exactly instead, with the largest ratio as probability 1, however little that keeps.

The table of cells has a row for each combination of categories that occurs. Up to CELLS of them are raked on the
driver; more are raked by the same steps as Spark jobs, and joined to the documents by shuffle instead of broadcast.

Defined cases: a null category is the category ''; a document counts at least one token, also if its text is null or
empty; targets are normed; categories that occur but have no target get none (probability 0), targets of categories
that don't occur are left out; rows that repeat an id share its fate; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import dropped, stored

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 40
#: Cells at most that are raked on the driver and broadcast.
CELLS = 100_000
#: Expected share of all tokens in a sample, if its targets are powers.
SHARE = 0.5

#: Topic of a text: the first whose mark it contains, else prose.
TOPICS = [("legal", " License"), ("credentials", "token = "), ("contact", "@"), ("table", " | ")]


@dataclass(frozen=True)
class Power:
    """Target shares in proportion to the tokens that are there, to a power: 1 keeps the shares, 0 makes them equal."""

    exponent: float


def tokens(text: Column) -> Column:
    """Space-separated tokens, at least 1."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.coalesce(spaces + 1, F.lit(1)).cast("bigint")


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, mark in reversed(TOPICS):
        out = F.when(text.contains(mark), name).otherwise(out)
    return out


def uniform(record_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from a hash of the id and the text: only rows that repeat both share it."""
    own = F.md5(F.coalesce(text, F.lit("")))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(":"), own))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def described(docs: DataFrame) -> DataFrame:
    """The documents with n_tokens and topic; null categories become ''."""
    return docs.withColumns(
        {
            "source": F.coalesce("source", F.lit("")),
            "lang": F.coalesce("lang", F.lit("")),
            "topic": topic(F.col("text")),
            "n_tokens": tokens(F.col("text")),
        }
    )


def rake(
    amount: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, share: float | None = None
) -> np.ndarray:
    """Parts of the cells whose sums by each dimension agree with the targets as far as the cells allow: of 1, or with
    share of that part of the amount, where no cell gives more than it has."""
    total = 1.0 if share is None else share
    most = np.full(len(amount), np.inf) if share is None else amount / amount.sum()
    part = total * amount / amount.sum()
    for _ in range(rounds):
        for place, target in zip(places, targets):
            now = np.bincount(place, part, len(target))
            part = part * np.divide(target * total, now, out=np.zeros(len(target)), where=now > 0)[place]
            part = np.minimum(part, most)
    return part / part.sum() if share is None and part.sum() > 0 else part


def meet(amount: np.ndarray, ratio: np.ndarray, share: float) -> float:
    """The factor c of min(1, c * ratio) that keeps a share of the amount; all that has a ratio, if that is less."""
    order = np.argsort(-ratio, kind="stable")
    order = order[ratio[order] > 0]
    if not len(order):
        return 0.0
    r, a = ratio[order], amount[order]
    full = np.cumsum(a) - a  # amount of the cells before each one, which saturate first
    open_part = np.cumsum((a * r)[::-1])[::-1]
    c = (share * amount.sum() - full) / open_part
    fits = np.flatnonzero(c * r <= 1)
    return c[fits[0]] if len(fits) else 1 / r[-1]


def scale(amount: np.ndarray, ratio: np.ndarray, share: float) -> float:
    """The factor c of min(1, c * ratio): 1 / the largest ratio, or more if that keeps less than share of the amount."""
    return max(1 / ratio.max(), meet(amount, ratio, share)) if ratio.max(initial=0) > 0 else 0.0


def _wish(wish: Power | dict[str, float], kinds: list, there: np.ndarray) -> np.ndarray:
    """Target shares of a dimension's categories."""
    if isinstance(wish, Power):
        share = np.power(there, wish.exponent)
    else:
        share = np.array([float(wish.get(k, 0.0)) for k in kinds])
    return share / share.sum() if share.sum() > 0 else share


def _by_driver(rows: list, targets: dict, rounds: int, share: float | None) -> list[tuple]:
    names = list(targets)
    rows.sort(key=lambda r: tuple(r[n] for n in names))
    amount = np.array([r["n_tokens"] for r in rows], float)
    places, shares = [], []
    for name in names:
        kinds, place = np.unique([r[name] for r in rows], return_inverse=True)
        places.append(place)
        shares.append(_wish(targets[name], kinds.tolist(), np.bincount(place, amount, len(kinds))))
    ratio = rake(amount, places, shares, rounds, share) / amount
    c = scale(amount, ratio, 0.0) if share is None else meet(amount, ratio, share)
    return [(*(r[n] for n in names), min(1.0, float(x * c))) for r, x in zip(rows, ratio)]


def _by_spark(cells: DataFrame, targets: dict, rounds: int, share: float | None) -> DataFrame:
    """What _by_driver does, with each round a job and its result in the shared folder."""
    spark, names = cells.sparkSession, list(targets)
    whole = cells.agg(F.sum("n_tokens")).first()[0]
    total = 1.0 if share is None else share
    goals = {}
    for name, wish in targets.items():
        there = cells.groupBy(name).agg(F.sum("n_tokens").cast("double").alias("there"))
        if isinstance(wish, Power):
            goal = there.select(name, F.pow("there", F.lit(wish.exponent)).alias("goal"))
        else:
            given = spark.createDataFrame([(k, float(v)) for k, v in wish.items()], "kind string, goal double")
            goal = there.join(given, F.col(name) == F.col("kind"), "left").select(name, F.coalesce("goal", F.lit(0.0)).alias("goal"))
        norm = goal.agg(F.sum("goal")).first()[0] or 1.0
        goals[name] = stored(goal.select(name, (F.col("goal") * total / norm).alias("goal")), "goals")
    most = F.lit(float("inf")) if share is None else F.col("n_tokens") / whole
    part = stored(cells.withColumn("part", F.col("n_tokens") * total / whole), "cells")
    for _ in range(rounds):
        last, now = part, part
        for name in names:
            sums = now.groupBy(name).agg(F.sum("part").alias("sum")).join(goals[name], name)
            factor = sums.select(name, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor"))
            now = now.join(factor, name).withColumn("part", F.least(F.col("part") * F.col("factor"), most)).drop("factor")
        part = stored(now, "cells")
        dropped(spark, last)
    ratio = part.select(*names, "n_tokens", (F.col("part") / F.col("n_tokens")).alias("ratio"))
    top = ratio.agg(F.max("ratio"), F.min(F.when(F.col("ratio") > 0, F.col("ratio")))).first()
    if share is None or not top[0]:
        c = 1 / top[0] if top[0] else 0.0
    else:
        low, high = 0.0, 1 / top[1]
        for _ in range(60):
            c = (low + high) / 2
            kept = ratio.agg(F.sum(F.least(F.lit(1.0), F.col("ratio") * c) * F.col("n_tokens"))).first()[0]
            low, high = (c, high) if kept < share * whole else (low, c)
    return ratio.select(*names, F.least(F.lit(1.0), F.col("ratio") * c).alias("probability"))


def probabilities(
    described_docs: DataFrame, targets: dict[str, Power | dict[str, float]], rounds: int = ROUNDS
) -> tuple[DataFrame, bool]:
    """A row for each cell: the dimensions' columns and its probability; and whether they are few (CELLS at most)."""
    names = list(targets)
    share = SHARE if all(isinstance(t, Power) for t in targets.values()) else None
    cells = described_docs.groupBy(*names).agg(F.sum("n_tokens").alias("n_tokens"))
    rows = cells.limit(CELLS + 1).collect()
    if len(rows) > CELLS:
        return _by_spark(stored(cells, "cells"), targets, rounds, share), False
    schema = ", ".join(f"`{n}` string" for n in names) + ", probability double"
    found = _by_driver(rows, targets, rounds, share) if rows else []
    return described_docs.sparkSession.createDataFrame(found, schema), True


def _with_probability(frame: DataFrame, described_docs: DataFrame, targets: dict, rounds: int = ROUNDS) -> DataFrame:
    cells, few = probabilities(described_docs, targets, rounds)
    return frame.join(F.broadcast(cells) if few else cells, list(targets), "left")


def calibrated(docs: DataFrame, targets: dict[str, Power | dict[str, float]], rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of each document."""
    drawn = docs.select("doc_id", "text", "lang", "source", uniform(F.col("doc_id"), F.col("text")).alias("drawn"))
    frame = described(drawn).drop("text")
    kept = F.col("drawn") < F.coalesce("probability", F.lit(0.0))
    return _with_probability(frame, frame.drop("drawn"), targets, rounds).withColumn("kept", kept).drop("drawn")


def sampled(docs: DataFrame, targets: dict[str, Power | dict[str, float]]) -> DataFrame:
    """The sample's documents with their own columns alone."""
    names = list(docs.columns)
    whole = docs.withColumn("whole", F.struct(*(F.col(f"`{n}`") for n in names)))
    drawn = uniform(F.col("doc_id"), F.col("text")).alias("drawn")
    frame = described(whole.select("doc_id", "text", "lang", "source", "whole", drawn)).drop("text")
    kept = F.col("drawn") < F.coalesce("probability", F.lit(0.0))
    return _with_probability(frame, frame.drop("whole", "drawn"), targets).where(kept).select("whole.*")


# ---- query ----

#: Sources are evened out (the hot one most), languages half, topics keep their shares.
TARGETS = {"source": Power(0.3), "lang": Power(0.5), "topic": Power(0.8)}


def op9_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's probability and whether the sample has it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return calibrated(docs, TARGETS).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "kept"
    )


def _topic_sql() -> str:
    return "case " + " ".join(f"when contains(text, '{mark}') then '{name}'" for name, mark in TOPICS) + " else 'prose' end"


def _oracle() -> str:
    ns = list(TARGETS)
    wish = ", ".join(
        f"power(sum(a) over (partition by {n}), {TARGETS[n].exponent}e0) / "
        f"(select sum(power(s, {TARGETS[n].exponent}e0)) from (select sum(a) s from cell group by {n})) as t_{n}"
        for n in ns
    )
    nested = "prev"
    for n in ns:
        nested = f"(select * replace (least(w * t_{n} * {SHARE}e0 / sum(w) over (partition by {n}), m) as w) from {nested})"
    return f"""
with recursive doc as (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, {_topic_sql()} as topic,
    coalesce(length(text) - length(replace(text, ' ', '')) + 1, 1)::bigint as n_tokens, md5(coalesce(text, '')) as own from documents),
cell as (select source, lang, topic, sum(n_tokens)::double as a from doc group by all),
goal as (select *, {wish} from cell),
ipf as (
  select 0 as round, *, {SHARE}e0 * a / sum(a) over () as w, a / sum(a) over () as m from goal
  union all
  select round + 1, * exclude (round) from {nested.replace("prev", f"(select * from ipf where round < {ROUNDS}) prev")}),
ratio as (select source, lang, topic, a, w / a as r from ipf where round = {ROUNDS}),
open_cells as (
  select *, ({SHARE}e0 * sum(a) over () - coalesce(sum(a) over (x rows between unbounded preceding and 1 preceding), 0))
    / sum(a * r) over (x rows between current row and unbounded following) as c, row_number() over x as nth
  from ratio where r > 0 window x as (order by r desc, source, lang, topic)),
factor as (select coalesce(min_by(c, nth) filter (c * r <= 1), 1 / min(r)) as c from open_cells),
prob as (select source, lang, topic, least(1e0, r * (select c from factor)) as probability from ratio)
select doc_id, d.source, d.lang, d.topic, n_tokens, round(probability, 9) as probability,
  ('0x' || left(md5('mix' || coalesce(doc_id::varchar, '') || ':' || own), 8))::bigint / 4294967296e0 < probability as kept
from doc d join prob p on d.source = p.source and d.lang = p.lang and d.topic = p.topic
"""


ORACLE = _oracle()
