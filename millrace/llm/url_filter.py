"""URL filtering: prefix rules first, else gradient-boosted trees on lexical features.

A rule names a host and a path; it fits that host and its subdomains where the URL's path starts with the rule's, and
the longest fitting rule decides. For other URLs a boosted-trees classifier decides, trained on about SAMPLE labelled
URLs. Features: lengths, depth, digit and hyphen shares, character entropy, counts of parameters and host labels, and
of the host's last label its length and how frequent it is among all URLs, in powers of two. No feature knows a label:
the suffix statistics come from the URLs alone, so a suffix isn't blocked because a rule blocks one site under it.
All of it runs as DataFrame operations and Spark ML. Every suffix has its own frequency: those of at least one URL in
2^(FREQUENT + 1) are broadcast, the others joined.

Defined cases: a null URL or one without `://` has an empty host and path and no rule, and is judged by its features
as an empty string is; without labelled URLs, or with only one kind, that kind (allow, if none) is the method's
verdict; repeated rows are judged alike; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: Labelled URLs to learn from, about; chosen by a hash of page and URL, so a repeated URL is thinned like others.
SAMPLE = 20_000
#: Largest rarity of the suffixes that are broadcast: there are less than 2^(FREQUENT + 1) of them.
FREQUENT = 12.0
TREES, DEPTH, SEED = 12, 4, 7
FEATURES = [
    "url_length",
    "host_length",
    "path_length",
    "depth",
    "labels",
    "digits",
    "hyphens",
    "parameters",
    "fragment",
    "entropy",
    "suffix_length",
    "suffix_rarity",
]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """A rule from its text: host up to the first slash, then path."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, host, slash + rest)


def parts(urls: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url (never null), host, path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return urls.select(
        F.col(id_col).alias("page_id"),
        url.alias("url"),
        F.translate(host, upper, upper.lower()).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def longest_rule(rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix() -> Column:
    return F.substring_index("host", ".", -1)


#: Rarity of a suffix that is not in the table.
RARE = 20.0


def suffix_table(urls: DataFrame, most: int | None = None) -> DataFrame:
    """suffix, suffix_rarity of every suffix of all URLs (most: of the most frequent ones): each halving of its share
    counts one."""
    counts = urls.groupBy(suffix().alias("suffix")).agg(F.count(F.lit(1)).alias("n"))
    top = stored(counts.orderBy(F.desc("n"), "suffix").limit(most) if most else counts, "url-suffixes")
    total = top.agg(F.sum("n")).first()[0] or 1
    rarity = F.least(F.lit(RARE), F.floor(-F.log2(F.col("n") / float(total)))).cast("double")
    return top.select("suffix", rarity.alias("suffix_rarity"))


def features(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The features beside url, host and path; suffixes: what suffix_table() gives."""
    url, n = F.col("url"), F.length("url")

    def count(column: Column, character: str) -> Column:
        return (F.length(column) - F.length(F.replace(column, F.lit(character), F.lit("")))).cast("double")

    shares = F.transform(
        F.array_distinct(F.split(url, "")), lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    )
    entropy = F.aggregate(
        F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda total, p: total - p * F.log2(p)
    )
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    frame = urls.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/"),
            "labels": count(F.col("host"), "."),
            "digits": F.when(n > 0, digits / n).otherwise(0.0),
            "hyphens": count(F.col("host"), "-"),
            "parameters": count(url, "&") + count(url, "?"),
            "fragment": count(url, "#"),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "suffix": suffix(),
            "suffix_length": F.length(suffix()).cast("double"),
        }
    )
    often, seldom = suffixes.where(F.col("suffix_rarity") <= FREQUENT), suffixes.where(F.col("suffix_rarity") > FREQUENT)
    frame = frame.join(F.broadcast(often), "suffix", "left")
    # Each of the seldom suffixes has few URLs; those that are done are dealt out under keys that are no suffix (a dot).
    done = F.concat(F.lit("."), F.pmod(F.xxhash64("url"), F.lit(1 << 20)).cast("string"))
    key = F.when(F.col("suffix_rarity").isNull(), F.col("suffix")).otherwise(done)
    seldom = seldom.select(F.col("suffix").alias("_key"), F.col("suffix_rarity").alias("_rarity"))
    frame = frame.withColumn("_key", key).join(seldom, "_key", "left")
    return frame.withColumn("suffix_rarity", F.coalesce("suffix_rarity", "_rarity", F.lit(RARE))).drop("_key", "_rarity")


@dataclass
class Filter:
    """A trained filter: its trees (or the one verdict that it knows) and its suffix table."""

    trees: GBTClassificationModel | None
    only: str
    suffixes: DataFrame


def train(labelled: DataFrame, suffixes: DataFrame | None = None, sample: int = SAMPLE) -> Filter:
    """Learns from url, host, path, verdict (allow or block), and page_id if it is there; about `sample` rows are used,
    chosen by a hash. suffixes: what suffix_table() gives of all URLs (of the labelled ones if not given)."""
    n = labelled.count()
    suffixes = suffix_table(labelled) if suffixes is None else suffixes
    key = [c for c in ("page_id", "url") if c in labelled.columns]
    rows = labelled.select(*key, "host", "path", (F.col("verdict") == "block").cast("double").alias("label"))
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    rows = stored(rows, "labelled-urls")
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Filter(None, "block" if kinds == [1.0] else "allow", suffixes)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, suffixes))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3).fit(
        stored(ready.select("features", "label").repartition(2), "url-features")
    )
    return Filter(trees, "", suffixes)


def judge(urls: DataFrame, trained: Filter, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability; urls: what parts() gives."""
    frame = urls.withColumn("fit", longest_rule(rules))
    if trained.trees is None:
        frame = frame.withColumn("block_probability", F.lit(float(trained.only == "block")))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(frame, trained.suffixes))
        margin = F.element_at(F.col("raw"), 2)
        trained.trees.setRawPredictionCol("raw_vector").setProbabilityCol("").setPredictionCol("")
        from pyspark.ml.functions import vector_to_array

        frame = (
            trained.trees.transform(ready)
            .withColumn("raw", vector_to_array("raw_vector"))
            .withColumn("block_probability", 1 / (1 + F.exp(-2 * margin)))
        )
    verdict = F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")
    return frame.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", verdict).alias("verdict"),
        F.round("block_probability", 6).alias("block_probability"),
    )


# ---- query ----

RULES = [
    rule("block", "net/"),
    rule("allow", "example.net/en/"),
    rule("block", "example.com/de/"),
    rule("allow", "org/fr/"),
]


def op8_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; the URLs that a rule decides are the labelled ones."""
    urls = parts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    labelled = urls.withColumn("fit", longest_rule(RULES)).where(F.col("fit").isNotNull())
    trained = train(labelled.select("page_id", "url", "host", "path", "fit.verdict"), suffix_table(urls))
    return judge(urls, trained, RULES)
