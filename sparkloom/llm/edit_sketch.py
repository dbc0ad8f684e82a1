"""Document fingerprints by randomised edit embedding.

A walk over a text's characters stays on a character until that character's own random
bit for the current step is 1, then moves on.  All texts share the bits, so two texts
walk alike while they are alike, and fall back into step after an edit: edit distance
becomes Hamming distance of the walks.  A fingerprint samples 128 steps of the walk and
keeps four bits of the character there.  The sample of each slot is consistent: it is
the last record of a shared random order before the walk ends, which is uniform over the
walk and moves only where lengths force it to.

``near_groups`` finds near copies: bands of slots propose, fingerprints and then an
edit-distance bound verify.

Defined results: null text counts as empty; the empty text's fingerprint is all zeros.
Equal texts have equal fingerprints.  Rows that repeat an id stand one after the other,
ordered by text; rows without an id come last.  A lone row's next document is itself.
An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket_of, id_buckets, parts, read, stored
from .graph import components

#: Slots of a fingerprint, classes of characters, steps after which bits repeat.
SLOTS, CLASSES, PERIOD = 128, 64, 1 << 14
#: Characters that walk at once.
BLOCK = 4_000_000
_SEED = 20240613


def _tables():
    rng = np.random.default_rng(_SEED)
    bits = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    delta = np.empty((CLASSES, 2 * PERIOD), np.int32)
    twice, wait = np.concatenate([bits, bits], axis=1), np.full(CLASSES, 1, np.int32)
    for j in reversed(range(2 * PERIOD)):
        wait = np.where(twice[:, j] == 1, 1, wait + 1)
        delta[:, j] = wait
    records = []
    for _ in range(SLOTS):
        row = [0]
        while row[-1] < 1 << 40:
            row.append(max(row[-1] + 1, int((row[-1] + 1) / max(rng.random(), 1e-9))))
        records.append(np.array(row, np.int64))
    return delta[:, :PERIOD].ravel().copy(), records


_SHARED: list = []


def _shared():
    if not _SHARED:
        _SHARED.extend(_tables())
    return _SHARED


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _walked(texts: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (rows of four-bit values) of nonempty texts, walked side by side."""
    delta, records = _shared()
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    flat = np.concatenate([texts[i] for i in order])
    mixed = flat * np.uint32(2654435761)
    classes = ((mixed >> np.uint32(26)).astype(np.int32)) * PERIOD
    # by place: texts are sorted by length, so those that reach a place come first
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    starts = np.concatenate([[0], np.cumsum(active)[:-1]])
    by_place = np.empty(len(flat), np.int32)
    for d in range(len(sizes)):
        by_place[starts[: sizes[d]] + d] = classes[begins[d] : ends[d]]
    steps, at = np.empty(len(flat), np.int32), np.zeros(len(sizes), np.int32)
    index = np.empty(len(sizes), np.int32)
    for s, m in zip(starts.tolist(), active.tolist()):
        now, i = at[:m], index[:m]
        steps[s : s + m] = now
        np.bitwise_and(now, PERIOD - 1, out=i)
        i += by_place[s : s + m]
        now += delta[i]
    total = at.astype(np.int64)
    # back to one text after the other, with steps that grow over all texts
    base = np.cumsum(total) - total
    walk = np.empty(len(flat), np.int64)
    for d in range(len(sizes)):
        walk[begins[d] : ends[d]] = steps[starts[: sizes[d]] + d]
        walk[begins[d] : ends[d]] += base[d]
    wanted = np.stack([r[np.searchsorted(r, total, "left") - 1] for r in records], axis=1)
    found = np.searchsorted(walk, (wanted + base[:, None]).ravel(), "right") - 1
    out = np.empty((len(sizes), SLOTS), np.uint8)
    out[order] = (mixed[found] >> np.uint32(12) & np.uint32(15)).reshape(len(sizes), SLOTS).astype(np.uint8)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of ``SLOTS`` four-bit values for each text."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    group, points, held = [], [], 0
    for i, t in enumerate(texts):
        if t:
            group.append(i)
            points.append(_points(t))
            held += len(points[-1])
        if held >= BLOCK or (i == len(texts) - 1 and group):
            out[group] = _walked(points)
            group, points, held = [], [], 0
    return out


def spelled(prints: np.ndarray) -> list[str]:
    packed = prints[:, 0::2] << 4 | prints[:, 1::2]
    return [row.tobytes().hex() for row in packed]


def _with_next(docs: DataFrame) -> DataFrame:
    """``bucket, key, doc_id, text, guest``: rows dealt by id ranges and sorted from the last
    id down.  After each bucket comes, as a guest, the row that follows its last one."""
    n = parts(docs.sparkSession)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    docs = docs.withColumn("key", key)
    bounds = id_buckets(docs, "key", 2 * n)
    docs = docs.withColumn("bucket", bucket_of(F.col("key"), bounds))
    heads = sorted((r["bucket"], r["head"]) for r in docs.groupBy("bucket").agg(F.max("key").alias("head")).collect())
    to = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    own = F.array("bucket")
    if to:
        pairs = F.create_map(*[F.lit(x) for head, bucket in to.items() for x in (head, bucket)])
        both = F.array(F.col("bucket"), F.element_at(pairs, F.col("key")))
        own = F.when(F.col("key").isin(list(to)), both).otherwise(own)
    dealt = docs.select("key", "doc_id", "text", F.posexplode(own).alias("guest", "bucket"))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), "text").select("bucket", "guest", "doc_id", "text")


def with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced from the
    next document's beginning, in descending order of ids."""

    def done(rows):
        """Results of all rows but the last, which is only the next of the one before."""
        mine = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        texts = [r[3] or "" for r in rows]
        edited = []
        for i in mine:
            cut = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        prints, other = fingerprints(texts), fingerprints(edited)
        names, other_names = spelled(prints), spelled(other)
        here, after = prints[mine], prints[[i + 1 for i in mine]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in mine], pa.int64()),
                pa.array([len(texts[i]) for i in mine], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([names[i] for i in mine], pa.string()),
                pa.array(other_names, pa.string()),
                pa.array((here == other).mean(axis=1) if mine else [], pa.float64()),
                pa.array((here == after).mean(axis=1) if mine else [], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def sketch(batches):
        rows, held = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(r)
                held += len(r[3] or "")
                if held >= 2 * BLOCK:
                    yield done(rows)
                    rows, held = rows[-1:], len(r[3] or "")
        if len(rows) > 1:
            yield done(rows)

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _with_next(docs).mapInArrow(sketch, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether ``a`` becomes ``b`` by at most ``most`` insertions, deletions and
    replacements: furthest-reaching diagonals, in time ``len * most`` at worst."""
    x, y = _points(a), _points(b)
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return False

    def run(i: int, j: int) -> int:
        while i < n and j < m:
            k = min(n - i, m - j, 256)
            differ = np.flatnonzero(x[i : i + k] != y[j : j + k])
            if len(differ):
                return i + int(differ[0])
            i, j = i + k, j + k
        return i

    far = {0: run(0, 0)}
    for d in range(most + 1):
        if far.get(n - m, -1) >= n:
            return True
        new = {}
        for k in range(-d - 1, d + 2):  # diagonal i - j
            i = max(far.get(k, -2) + 1, far.get(k - 1, -2) + 1, far.get(k + 1, -2))
            i = min(i, n, m + k)
            if i >= 0 and i - k >= 0:
                new[k] = run(i, i - k)
        far = new
    return False


def near_groups(docs: DataFrame, part: float = 0.05, bands: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id``: texts tied by edit distances of at most ``part`` of the longer.

    Equal texts are one node.  Each bucket's texts are compared with its smallest id, which
    is linear in the bucket; what these links leave in other components than the bucket's
    largest is compared with all texts of other components there, so no link that any band
    proposes is lost.  Rows without an id stay alone.
    """

    def prints(batches):
        for b in batches:
            found = fingerprints([t or "" for t in b.column(1).to_pylist()])
            width = SLOTS // bands
            keys = [[row[i * width : (i + 1) * width].tobytes().hex() + f":{i}" for i in range(bands)] for row in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.string()))], ["node", "keys"])

    def verify(batches):
        for b in batches:
            a, c, x, y = (col.to_pylist() for col in b.columns)
            ok = [i for i in range(len(a)) if edits_within(x[i], y[i], int(part * max(len(x[i]), len(y[i]))))]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in ok], pa.int64()) for v in (a, c)], ["a", "b"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = stored(rows.select("doc_id", F.sha2("text", 256).alias("digest")), "named")
    nodes = stored(named.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    texts = stored(rows.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "text"), "texts")
    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(v)) for k, v in (("a", "x"), ("b", "y")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")

    keyed = stored(texts.mapInArrow(prints, "node long, keys array<string>").select("node", F.explode("keys").alias("bucket")), "keyed")
    pivots = keyed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("k")).where("k > 1").drop("k")
    shared = stored(keyed.join(pivots, "bucket"), "shared")
    star = stored(shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "star")
    links = confirmed(star)
    placed = shared.join(components(links).withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    placed = stored(placed, "placed")
    sizes = placed.groupBy("bucket", "c").count()
    main = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    opened = stored(placed.join(main, "bucket"), "opened")
    outer = opened.where("c <> main").select("bucket", F.col("node").alias("n1"), F.col("c").alias("c1"))
    other = (F.col("c1") != F.col("c")) & ((F.col("c") == F.col("main")) | (F.col("n1") < F.col("node")))
    rest = outer.join(opened, "bucket").where(other).select(F.least("n1", "node").alias("a"), F.greatest("n1", "node").alias("b")).distinct()
    groups = components(links.union(confirmed(rest.join(star, ["a", "b"], "left_anti"))))
    found = named.join(nodes, "digest", "left").join(groups, "node", "left")
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))


def op1_edit_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(read(spark, sf_dir, "documents"))
