"""Near-duplicate classes by ProbMinHash, banding and verification.

A text's shingles are its runs of five words (lower case, letters, digits and underscores), weighted by how often they
occur; a text of fewer words is one shingle. Each weighted shingle has, for every register, an exponential arrival
time at the rate of its weight; a register keeps the shingle that arrives first. Two texts agree in a register with
the probability Jaccard similarity of their weighted shingles. A shingle's arrivals are generated in rising order and
stop at the latest time that a register still holds, so few are generated.

Registers are cut into bands; texts that agree in a whole band are candidates, and a candidate pair is a link if its
exact probability Jaccard is at least THRESHOLD. Classes are the connected components of the links. Equal word
sequences are one node, so copies are never paired. In each band's bucket the first and the last node are paired with
every other one; after these pairs are verified, the pairs of nodes of a bucket that aren't yet in one class are compared in
blocks, screened by their registers' agreement, so no link between classes is lost by the shortcut and none of a
class's many inner pairs is made.

Bands miss a pair at exactly 0.8 with a probability of 0.0002, and more similar ones more rarely. Nodes are 64-bit
hashes of word sequences.

Defined cases: a null text is alone in its class; texts without words are copies if they are equal; rows that repeat
an id with equal texts share a class; a class is named by its least doc_id (null if none of its rows has one); an
empty table gives no rows; other columns of the input are ignored; texts count whole.

Groups may be large: rows of equal texts are summed up before they are shuffled, and where rows are joined to a table
by class or bucket, that table is stored first, so that AQE can split a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import dropped, small_batches, stored

WORDS = 5
THRESHOLD = 0.8
REGISTERS = 256
BANDS, ROWS = 36, 7
#: Share of agreeing registers under which a pair's similarity isn't 0.8: five standard deviations less.
SCREEN = 0.675
#: Characters worked on at once.
CHUNK = 1 << 18
#: Nodes of a bucket that are compared with each other, or with as many others, in one group.
BLOCK = 512

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finish of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        inverse = pow(int(_A), -1, 1 << 64)
        one = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate([one, np.full(n - 1, _A)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([one, np.full(n - 1, inverse, np.uint64)]), dtype=np.uint64)
    return up, down


def _pieces(text: str) -> list[str]:
    """The text cut at spaces into pieces of at most CHUNK characters."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
        cut = cut if cut > at else end
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word in order: its text and hash."""
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(code) + 2, np.int8)
    inside[1:-1] = _word_characters()[code]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, int(len(code)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(code + _C) * up[: len(code)], dtype=np.uint64)])
        word = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _C)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.searchsorted(np.cumsum(lengths), start, "right")
    return owner, word


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts in order: its text and hash."""
    pieces = [(i, p) for i, t in enumerate(texts) for p in _pieces(t.lower())]
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= CHUNK):
            size += len(pieces[end][1])
            end += 1
        owner, word = _hash_words([p for _, p in pieces[at:end]])
        owners.append(np.array([i for i, _ in pieces[at:end]], np.int64)[owner])
        found.append(word)
        at = end
    return np.concatenate(owners), np.concatenate(found)


def nodes(texts: list[str], owner: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's word sequence; of the text itself if it has no words."""
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        up = _powers(1 << max(16, int(count.max(initial=1)).bit_length()))[0]
        terms = np.concatenate([word * up[np.arange(len(word)) - first[owner]], np.zeros(1, np.uint64)])
        out = _mix(np.add.reduceat(terms, first) + count.astype(np.uint64) * _B) if len(texts) else terms[:0]
    for i in np.flatnonzero(count == 0):
        out[i] = xxhash.xxh64_intdigest(texts[i].encode("utf-8", "surrogatepass"), seed=1)
    return out.view(np.int64)


def shingles(n: int, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of n texts: the text, the hash (48 bits), how often; by text, then hash."""
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        runs = max(0, len(word) - WORDS + 1)
        s = np.zeros(runs, np.uint64)
        for k in range(WORDS):
            s = (s + word[k : runs + k]) * _A
        whole = owner[:runs] == owner[WORDS - 1 :] if runs else np.zeros(0, bool)
        s, own = _mix(s[whole]), owner[:runs][whole]
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            more = np.zeros(len(short), np.uint64)
            for k in range(WORDS - 1):
                there = count[short] > k
                more[there] = (more[there] + word[first[short][there] + k]) * _A
            s, own = np.concatenate([s, _mix(more)]), np.concatenate([own, short])
    key = np.sort((own.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)))
    new = np.flatnonzero(np.diff(key, prepend=np.uint64(0)) != 0)
    if len(key) and key[0] == 0:
        new = np.concatenate([[0], new])
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & _LOW, times


def prob_min_hash(n: int, owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(n, REGISTERS): the shingle that arrives first in each register of each text."""
    time = np.full(n * REGISTERS, np.inf)
    first = np.zeros(n * REGISTERS, np.uint64)
    with np.errstate(over="ignore"):
        seed = _mix(shingle * _A + _B)
        start = (_mix(seed + _C) >> np.uint64(40)).astype(np.int64)
        stride = (_mix(seed ^ _A) >> np.uint64(40)).astype(np.int64) | 1  # odd: every register comes once
        base, rate = owner * REGISTERS, weight.astype(np.float64)
        now = np.zeros(len(owner))
        for arrival in range(REGISTERS):
            if not len(owner):
                break
            random = _mix(seed + np.uint64(arrival + 1) * _A) >> np.uint64(11)
            now = now - np.log((random.astype(np.float64) + 0.5) * 2.0**-53) / (rate * (REGISTERS - arrival))
            place = base + ((start + arrival * stride) & (REGISTERS - 1))
            np.minimum.at(time, place, now)
            won = time[place] == now
            first[place[won]] = shingle[won]
            latest = time.reshape(n, REGISTERS).max(axis=1)
            go = now < latest[owner]
            owner, shingle, seed, start, stride, base, rate, now = (
                x[go] for x in (owner, shingle, seed, start, stride, base, rate, now)
            )
    return first.reshape(n, REGISTERS)


def band_keys(first: np.ndarray) -> np.ndarray:
    """(n, BANDS): a hash of each band's registers and number."""
    with np.errstate(over="ignore"):
        out = np.empty((len(first), BANDS), np.uint64)
        for band in range(BANDS):
            h = np.full(len(first), band + 1, np.uint64)
            for k in range(ROWS):
                h = _mix(h * _A + first[:, band * ROWS + k])
            out[:, band] = h
        return out.view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two texts' shingles a, b (distinct, ascending) and their weights x, y."""
    if not len(a) or not len(b):
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if x.max() == 1 and y.max() == 1:
        return len(common) / (len(a) + len(b) - len(common))
    xs, ys = x[i].astype(np.float64), y[j].astype(np.float64)
    ratio = xs / ys
    order = np.argsort(ratio)
    xs, ys, ratio = xs[order], ys[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, "right")  # shingles of at most this ratio
    below = np.concatenate([[0.0], np.cumsum(ys)])[upto] + (y.sum() - ys.sum())
    above = (x.sum() - np.concatenate([[0.0], np.cumsum(xs)])[upto])
    return float((1 / (above / xs + below / ys)).sum())


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or (size + len(texts[end]) <= CHUNK and end - at < 4096)):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of the text: with doc_id it tells rows apart), node (null for a null text), bands (array of
    keys; empty without words), registers (a byte of each)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = source.withColumn("key", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            texts = [t or "" for t in raw]
            for at, end in _chunks(texts):
                part = texts[at:end]
                owner, word = words(part)
                node = nodes(part, owner, word)
                with_words = np.bincount(owner, minlength=len(part)) > 0
                first = prob_min_hash(len(part), *shingles(len(part), owner, word))
                keys = band_keys(first)
                byte = (_mix(first) >> np.uint64(56)).astype(np.uint8)
                none = np.array([t is None for t in raw[at:end]], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, end - at),
                        batch.column(2).slice(at, end - at),
                        pa.array(node, pa.int64(), mask=none),
                        pa.array([k if w else [] for k, w in zip(keys, with_words)], pa.list_(pa.int64())),
                        pa.array([r.tobytes() for r in byte], pa.binary()),
                    ],
                    ["doc_id", "key", "node", "bands", "registers"],
                )

    return source.mapInArrow(task, f"doc_id {kind}, key bigint, node bigint, bands array<bigint>, registers binary")


def own_texts(rows: DataFrame) -> DataFrame:
    """The rows (node, text) whose text is the node's; else an id that stands for several texts would bring others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                yield batch.filter(pa.array(nodes(texts, *words(texts)) == batch.column(0).to_numpy()))

    return rows.mapInArrow(task, "node bigint, text string").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b) whose exact similarity is at least THRESHOLD; texts: node, text."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                n = batch.num_rows
                texts = batch.column(2).to_pylist() + batch.column(3).to_pylist()
                owner, word = words(texts)
                of, shingle, times = shingles(2 * n, owner, word)
                cut = np.searchsorted(of, np.arange(2 * n + 1))
                good = []
                for i in range(n):
                    p, q = slice(cut[i], cut[i + 1]), slice(cut[n + i], cut[n + i + 1])
                    if probability_jaccard(shingle[p], times[p], shingle[q], times[q]) >= THRESHOLD - 1e-9:
                        good.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good, pa.int32())) for k in (0, 1)], ["a", "b"])

    return both.mapInArrow(task, "a bigint, b bigint").distinct()


def linked_in_buckets(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b: links that connect all nodes of a bucket whose similarity connects them.

    rows: band, node, label, bands, registers, text; sizes: band, n (its nodes). Buckets are cut into blocks of about BLOCK nodes, and each pair
    of blocks is one group of rows, streamed through a task. A pair of nodes is looked at in the first band that both
    share, if they aren't connected yet (by label or by a link found before in the group) and enough registers agree;
    the most agreeing pairs come first. Only links that connect something are returned, at most one for each node.
    """
    blocks = sizes.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(blocks, "band")
        .withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label",
            "bands", "registers", "text",
        )
    )
    keys = ["band", "i", "j"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def links_of(group: list[tuple], shingle: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        own = np.array([r[3] for r in group])
        label = np.unique([r[5] for r in group], return_inverse=True)[1]
        bands = np.array([r[6] for r in group])
        registers = np.frombuffer(b"".join(r[7] for r in group), np.uint8).reshape(-1, REGISTERS)
        number = int(np.flatnonzero(bands[0] == group[0][0])[0])
        across = group[0][1] != group[0][2]
        found: list[tuple[float, int, int]] = []
        for k in range(len(group) - 1):
            rest = np.arange(k + 1, len(group))
            rest = rest[label[rest] != label[k]]
            if across:
                rest = rest[own[rest] != own[k]]
            rest = rest[~(bands[rest, :number] == bands[k, :number]).any(axis=1)]
            agree = (registers[rest] == registers[k]).mean(axis=1)
            found += [(-g, k, m) for g, m in zip(agree.tolist(), rest.tolist()) if g >= SCREEN]
        parent = list(range(int(label.max()) + 1))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for _, k, m in sorted(found):
            x, y = top(label[k]), top(label[m])
            if x != y and probability_jaccard(*shingle[k], *shingle[m]) >= THRESHOLD - 1e-9:
                parent[x] = y
                yield group[k][4], group[m][4]

    def linked(held: list[tuple]) -> pa.RecordBatch:
        texts = [r[8] for r in held]
        owner, word = words(texts)
        of, shingle, times = shingles(len(texts), owner, word)
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        each = [(shingle[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]) for i in range(len(texts))]
        out: list[tuple[int, int]] = []
        at = 0
        while at < len(held):
            end = at
            while end < len(held) and held[end][:3] == held[at][:3]:
                end += 1
            out += links_of(held[at:end], each[at:end])
            at = end
        columns = [pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if len(held) >= BLOCK and held[-1][:3] != row[:3]:
                        yield linked(held)
                        held = []
                    held.append(row)
        if held:
            yield linked(held)

    return ordered.mapInArrow(task, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label of every node with a link (a, b): label is the least node of its component.

    Each round every node takes the least label around it, and then its label's label. Labels pass through the shared
    folder, so a lost executor costs no more than the round at hand.
    """
    edges = links.union(links.select("b", "a")).toDF("node", "other")
    labels = stored(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        around = (
            edges.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        least = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        moved = stored(
            least.join(jump, "least").select("node", F.least("least", "far").alias("label"), F.col("label").alias("was")),
            "labels",
        )
        dropped(links.sparkSession, labels)
        labels = moved
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id of every row: class_id is the least doc_id of its near-duplicate class."""
    return _classified(docs, id_col, text_col).select("doc_id", "class_id")


def _classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, label (of the class; null for a null text), class_id of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = stored(sketches(docs), "sketches")
    keyed = sketched.select(F.explode("bands").alias("band"), "node")
    ends = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    ends = stored(ends, "ends")
    members = stored(keyed.join(ends, "band").distinct(), "buckets")  # band, node, low, high
    stars = (
        members.select(F.explode(F.array("low", "high")).alias("hub"), "node")
        .where("hub <> node")
        .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        .distinct()
    )
    stars = stored(stars, "pairs")
    candidates = members.select("node").distinct()
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    firsts = sketched.where(F.size("bands") > 0).groupBy("node").agg(F.min(row).alias("row"))
    firsts = stored(firsts.join(candidates, "node", "left_semi").select("node", "row.doc_id", "row.key"), "firsts")
    alike = sketched.select(*(F.col(c).alias(f"of_{c}") for c in ("node", "doc_id", "key")), "bands", "registers")
    its_own = F.col("doc_id").eqNullSafe(F.col("of_doc_id"))
    for c in ("node", "key"):
        its_own = its_own & (F.col(c) == F.col(f"of_{c}"))
    reps = firsts.join(alike, its_own).dropDuplicates(["node"])
    reps = stored(reps.select("node", "doc_id", "key", "bands", "registers"), "representatives")
    rows = docs.select(F.col("doc_id").alias("of"), F.xxhash64("text").alias("of_key"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    texts = reps.select("node", "doc_id", "key").join(rows, same).select("node", "text")
    texts = stored(own_texts(texts), "texts")
    links = stored(verified(stars, texts), "links")
    labels = components(links)

    at = members.select("band", "node").join(labels, "node", "left")
    at = at.select("band", "node", F.coalesce("label", "node").alias("label"))
    spread = at.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")
    )  # of up to three nodes the stars had all pairs
    spread = stored(spread.where("n > 3 and x < y").select("band", "n"), "open-buckets")
    open_rows = at.join(spread.select("band"), "band", "left_semi")
    details = reps.select("node", "bands", "registers").join(texts, "node")
    late = stored(linked_in_buckets(open_rows.join(details, "node"), spread), "links")
    if not late.isEmpty():
        labels = components(links.union(late))

    known = sketched.select("doc_id", "key", "node").join(labels, "node", "left")
    known = known.select("doc_id", "key", "node", F.coalesce("label", "node").alias("label"))
    named = known.groupBy("label").agg(F.min("doc_id").alias("class_id")).where("label is not null")
    named = stored(named, "class-names")
    return known.join(named, "label", "left").select(
        "doc_id",
        "key",
        "label",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document (all columns) of each class: that with the least doc_id, and of its texts that with the least hash.

    An id that stands for several texts counts for each of them; a class without any id keeps one of its rows. Rows
    with a null text stay, each distinct id once.
    """
    found = stored(_classified(docs).select("doc_id", "key", "label"), "classes")
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    first = found.where("label is not null").groupBy("label").agg(F.min(row).alias("row")).select("row.doc_id", "row.key")
    alone = found.where("label is null").select("doc_id", "key").distinct()
    own = "_kept"
    while own in map(str.lower, docs.columns):
        own += "_"
    kept = stored(first.unionByName(alone), "kept").select(F.struct("doc_id", "key").alias(own))
    same = docs["doc_id"].eqNullSafe(F.col(f"{own}.doc_id")) & (F.xxhash64(docs["text"]) == F.col(f"{own}.key"))
    one = docs.join(kept, same).dropDuplicates([own])
    return one.select(*(docs[f"`{c}`"] for c in docs.columns))


# ---- query ----


def op5_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
