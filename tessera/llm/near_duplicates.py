"""MinHash near-dedup by a chosen-path set similarity join.

A document is its set of distinct word shingles; equal sets are one class from the start, whatever
the number of copies. In each of several trees a class follows the path that the node it
is in chooses for it: a node names one of the minwise tokens, and classes that agree on it go on
together. Nodes that hold at most SMALL classes are compared exhaustively; larger ones branch
again, each class into CHILDREN children, and what is still large then is dealt into salted blocks
(other blocks in every tree, so that a group which one tree parts is joined by the next). Members of
a dealt node that then aren't in its largest component meet all its blocks, on full sets, so that the
blocks lose no link that the whole node would have found.

A comparison within a node works on 128-byte sketches and gives a maximum spanning forest over all
pairs that may reach the threshold, so a group of n costs n - 1 links and never all its pairs. Links
are confirmed on full sets. Where one fails, the node's members that are candidates somewhere are compared
again on full sets alone, all pairs whose ends aren't connected yet; so a link is lost only if no tree
brings its ends together or if the sketch errs by over DEVIATIONS (2.5e-6 of pairs at 0.85, 1.3e-6 at 0.8).

A tree brings a pair of similarity J together with J^3 where its nodes are small, and with
J^3 (1 - (1 - J^3)^CHILDREN) where they branch. `trees_for` takes as many trees as keep the pairs at the
threshold that none brings together below MISSED even where all nodes branch, with the tokens that all
trees share counted in: 17 trees at 0.85 (1.3e-5 where nodes branch, 1.6e-6 where they are small) and
25 at 0.8 (2.0e-5 and 6.7e-7).

A class's full set comes from one of its texts, which is found by id and a hash of the text, so rows that
share an id, null included, cost no more than others. Hashes of shingles have 64 bits.

Null texts and texts without words have the empty set and link with nothing; fewer words than a
shingle are one shingle; copies share a class; rows with a null id take part and have a null component
only where no member has an id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, in_arrow, mix, named, null_to_empty, slices, struct

SHINGLE, SIMILARITY = 5, 0.8
#: Three children need 17 trees at 0.85 and send a class of a large node to 51 places; six need 14 and 84, two need 20 and 40, but more rows where nodes are small.
DEPTH, CHILDREN, SMALL = 3, 3, 1000
COORDINATES = 128
#: Share of the pairs at the threshold that no tree may bring together, and the most trees.
MISSED, MOST_TREES = 2e-5, 64
#: Deviations by which a sketch may fall short of the threshold.
DEVIATIONS = 5
MEMORY_WORDS = 200_000
#: Bytes of a shingle's hash in a full set.
WIDTH = 8
#: Places that hashes fall on when shared ones are counted from above.
PLACES = 1 << 20

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_SEEDS = _rng.integers(0, 1 << 63, MOST_TREES, dtype=np.uint64)


class Shingler:
    """Sets of shingle hashes; one per worker task."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Sorted distinct 64-bit hashes of each text's shingles."""
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if len(self.known) > MEMORY_WORDS:
                self.known = {}
            self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in self.known)
            h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
            k = min(self.size, len(h))
            if not k:
                yield np.empty(0, np.uint64)
                continue
            out = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                out = mix(out * np.uint64(3) + h[i : len(h) - k + 1 + i])
            yield np.unique(out)


def packed(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def mark(data: bytes) -> bytes:
    """Names the class of a packed set."""
    return hashlib.blake2b(data, digest_size=16).digest()


def minwise(s: np.ndarray) -> np.ndarray:
    """COORDINATES minwise tokens of 32 bits."""
    s = mix(s + np.uint64(1))
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        best = np.minimum(best, (s[a : a + 4096, None] * _FACTORS + _TERMS).min(0))
    return best >> np.uint64(32)


def missed(similarity: float, trees: int, children: int) -> float:
    """Probability that no tree brings a pair together where every node branches, or with no children where none does."""
    out = 0.0
    for shared in range(COORDINATES + 1):
        one = (shared / COORDINATES) ** DEPTH
        if children:
            one *= 1 - (1 - one) ** children
        out += comb(COORDINATES, shared) * similarity**shared * (1 - similarity) ** (COORDINATES - shared) * (1 - one) ** trees
    return out


def trees_for(similarity: float) -> int:
    return next((t for t in range(1, MOST_TREES) if missed(similarity, t, CHILDREN) <= MISSED), MOST_TREES)


def _descend(node: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Nodes (a row per row of tokens) DEPTH tokens further down."""
    rows = np.arange(len(tokens)).reshape(-1, *[1] * (node.ndim - 1))
    for _ in range(DEPTH):
        chosen = (mix(node) % np.uint64(COORDINATES)).astype(np.int64)
        node = mix(node ^ mix(tokens[rows, chosen] + np.uint64(7)))
    return node


def paths(tokens: np.ndarray, trees: int) -> np.ndarray:
    """Nodes of classes (rows of tokens) after one descent: n x trees."""
    return _descend(np.broadcast_to(_SEEDS[:trees], (len(tokens), trees)), tokens)


def branches(nodes: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Nodes of classes after one more descent from each node, by the bytes of their sketches: n x CHILDREN."""
    start = mix(nodes[:, None] + np.arange(1, CHILDREN + 1, dtype=np.uint64))
    return _descend(start, signs.astype(np.uint64))


def _sketches(size: int, trees: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            texts = null_to_empty(batch.column(2).to_pylist())
            for a, b in slices(texts):
                n, marks, tokens, full = [], [], [], []
                for s in shingler.sets(texts[a:b]):
                    n.append(len(s))
                    marks.append(mark(packed(s)))
                    if len(s):
                        full.append(len(n) - 1)
                        tokens.append(minwise(s))
                signs, nodes = [None] * len(n), [None] * len(n)
                if full:
                    t = np.stack(tokens)
                    for i, sign, node in zip(full, t.astype(np.uint8), paths(t, trees).view(np.int64), strict=True):
                        signs[i], nodes[i] = sign.tobytes(), node
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(signs, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["id", "hash", "n", "class", "sign", "nodes"])

    return sketch


def _full_sets(size: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            # Rows that repeat both id and text all come here; one of a batch is enough.
            first = {c: i for i, c in reversed(list(enumerate(batch.column(0).to_pylist())))}
            rows = batch.take(pa.array(sorted(first.values()), pa.int64()))
            texts = null_to_empty(rows.column(1).to_pylist())
            for a, b in slices(texts):
                found = [packed(s) for s in shingler.sets(texts[a:b])]
                yield pa.RecordBatch.from_arrays([rows.column(0)[a:b], pa.array(found, pa.binary()), pa.array(map(mark, found), pa.binary())], names=["class", "shingles", "own"])

    return full


def by_node(work: Callable[[list[dict]], list[tuple]], names: list[str], kinds: list[pa.DataType]):
    """An Arrow function over rows sorted by their first column: work(rows of one node) gives the rows out. Holds one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if row["node"] != last:
                    if len(held) > 1:
                        found += work(held)
                    held, last = [], row["node"]
                held.append(row)
            yield out(found)
        if len(held) > 1:
            yield out(work(held))

    return run


def _sized(n: np.ndarray, i: int, low: float) -> np.ndarray:
    return np.minimum(n, n[i]) >= low * np.maximum(n, n[i])


def _forest(similarity: float):
    """A maximum spanning forest of a node by estimated similarity, over pairs that may reach the threshold."""
    low = similarity - DEVIATIONS * float(np.sqrt(similarity * (1 - similarity) / COORDINATES))

    def work(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: r["class"])
        signs = np.stack([np.frombuffer(r["sign"], np.uint8) for r in rows])
        n = np.array([r["n"] for r in rows])
        best, parent, waiting = np.full(len(rows), -1.0), np.full(len(rows), -1), np.ones(len(rows), bool)
        out = []
        for _ in range(len(rows)):
            i = int(np.where(waiting, best, -2.0).argmax())
            waiting[i] = False
            if best[i] >= low:
                out.append((rows[i]["node"], rows[parent[i]]["class"], rows[i]["class"]))
            guess = ((signs == signs[i]).mean(1) - 1 / 256) / (1 - 1 / 256)
            better = waiting & (guess > best) & (guess >= low) & _sized(n, i, similarity)
            best[better], parent[better] = guess[better], i
        return [(node, min(a, b), max(a, b)) for node, a, b in out]

    return work


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def similar(shared: int, n: int, m: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = unpacked(x.as_py()), unpacked(y.as_py())
                good.append(similar(common(a, b), len(a), len(b), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return confirm


def _exhaustive(percent: int):
    """Links between the components of a node, on full sets; pairs that are connected already are left out."""

    def work(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: (len(r["shingles"]), r["class"]))
        labels = np.unique([r["root"] for r in rows], return_inverse=True)[1].ravel()
        if labels.min() == labels.max():
            return []
        n = np.array([len(r["shingles"]) // WIDTH for r in rows])
        starts = np.cumsum(n) - n
        places = np.concatenate([(unpacked(r["shingles"]) % np.uint64(PLACES)).astype(np.uint32) for r in rows])
        seen = np.zeros(PLACES, bool)
        out = []
        for i in range(len(rows) - 1):
            # Rows are in the order of their size: those near enough follow at once.
            end = i + 1 + int(_sized(n, i, percent / 100)[i + 1 :].sum())
            rest = i + 1 + np.flatnonzero(labels[i + 1 : end] != labels[i])
            if not len(rest):
                continue
            seen[places[starts[i] : starts[i] + n[i]]] = True
            # Different hashes may share a place, so this is no less than what is shared.
            most = np.add.reduceat(seen[places[starts[i + 1] : starts[end - 1] + n[end - 1]]], starts[i + 1 : end] - starts[i + 1], dtype=np.int64)
            seen[places[starts[i] : starts[i] + n[i]]] = False
            own = unpacked(rows[i]["shingles"])
            for j in rest:
                if labels[j] == labels[i] or not similar(most[j - i - 1], n[i], n[j], percent):
                    continue
                if similar(common(own, unpacked(rows[j]["shingles"])), n[i], n[j], percent):
                    a, b = sorted((rows[i]["class"], rows[j]["class"]))
                    out.append((a, b))
                    labels[labels == labels[j]] = labels[i]
        return out

    return work


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the columns of their class; a class is joined once, whatever the number of its nodes."""
    others = [c for c in rows.columns if c != "class"]
    held = rows.groupBy("class").agg(F.collect_list(F.struct(*others)).alias("held"))
    return held.join(classes, "class").select(*classes.columns, F.inline("held"))


def _branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, tree, node, sign) to CHILDREN rows (class, tree, node) each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        nodes = branches(batch.column(2).to_numpy().view(np.uint64), signs)
        each = batch.take(pa.array(np.repeat(np.arange(len(nodes)), CHILDREN)))
        yield pa.RecordBatch.from_arrays([each.column(0), each.column(1), pa.array(nodes.ravel().view(np.int64))], names=["class", "tree", "node"])


def _nodes(classes: DataFrame, small: int) -> DataFrame:
    """Rows (node, class, dealt): the nodes that are compared; dealt is the node whose block this one is, else null."""
    rows = classes.select("class", F.posexplode("nodes").alias("tree", "node"))
    large = rows.groupBy("node").count().where(F.col("count") > small).select("node", F.lit(True).alias("large"))
    rows = rows.join(large, "node", "left")
    first = rows.where("large is null").select("node", "class", F.lit(None).cast("long").alias("dealt"))
    deeper = _with_class(rows.where("large").select("class", "tree", "node"), classes.select("class", "sign"))
    deeper = in_arrow(deeper.select("class", "tree", "node", "sign"), _branched, "class binary, tree int, node long")
    blocks = deeper.groupBy("node").count().select("node", F.ceil(F.col("count") / small).alias("blocks"))
    block = F.when(F.col("blocks") > 1, F.xxhash64("node", F.pmod(F.xxhash64("class", "tree"), F.col("blocks")))).otherwise(F.col("node"))
    second = deeper.join(blocks, "node").select(block.alias("node"), "class", F.when(F.col("blocks") > 1, F.col("node")).alias("dealt"))
    return first.unionByName(second)


def _across_blocks(nodes: DataFrame, roots: DataFrame, small: int) -> DataFrame:
    """Rows (node, class, root): members of dealt nodes outside their largest component, `small` at a time, with every block of their node."""
    members = nodes.where("dealt is not null").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    sizes = members.groupBy("dealt", "root").count()
    largest = sizes.groupBy("dealt").agg(F.max(F.struct("count", "root"))["root"].alias("most"), F.ceil((F.sum("count") - F.max("count")) / small).alias("parts")).where("parts > 0")
    members = members.join(largest, "dealt").select("dealt", "node", "class", "root", "most", "parts")
    each = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    blocks = members.select("*", each.alias("part"))
    rest = members.where("root <> most").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    all_blocks = members.select("dealt", F.col("node").alias("block")).distinct()
    rest = rest.join(all_blocks, "dealt").select(F.col("block").alias("node"), "class", "root", "part")
    met = blocks.select("node", "class", "root", "part").unionByName(rest)
    return met.select(F.xxhash64("node", "part").alias("node"), "class", "root").distinct()


def _per_node(rows: DataFrame, work, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    return in_arrow(rows.repartition("node").sortWithinPartitions("node"), by_node(work, names, kinds), schema)


def _sets_of(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Rows (class, shingles) of the wanted (class, sample): sample is (id, hash) of a text of the class. Other texts of that hash are found out."""
    own = wanted.select("class", F.col("sample.id").alias("of"), F.col("sample.hash").alias("hash"))
    one = rows.join(own, rows["id"].eqNullSafe(own["of"]) & (rows["hash"] == own["hash"])).select("class", "text")
    return in_arrow(one, _full_sets(shingle), "class binary, shingles binary, own binary").where("own = class").select("class", "shingles").dropDuplicates(["class"])


def link_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """A row per document: id_col, n_shingles, component_id (smallest id reachable over links), kept, class (of equal sets), copies."""
    percent, scratch = round(100 * similarity), Scratch(docs.sparkSession)
    text = named(text_col).cast("string")
    rows = docs.select(named(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    schema = struct([rows.schema["id"]], "hash long, n long, class binary, sign binary, nodes array<long>")
    sketched = scratch.save(in_arrow(rows, _sketches(shingle, trees_for(similarity)), schema), "sketches")
    full = sketched.where("n > 0")
    classes = scratch.save(full.groupBy("class").agg(F.min("id").alias("first"), F.min(F.struct("id", "hash")).alias("sample"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("sign").alias("sign"), F.any_value("nodes").alias("nodes")), "classes")
    # Nodes of one class have nothing to compare; they go before any sketch is sent.
    nodes = _nodes(classes, small)
    shared = nodes.groupBy("node").agg(F.count("*").alias("count"), F.any_value("dealt").alias("dealt")).where("count > 1 or dealt is not null").select("node")
    nodes = scratch.save(_with_class(nodes.join(shared, "node", "left_semi"), classes.select("class", "n", "sign")).select("node", "class", "dealt", "n", "sign"), "nodes")
    found = scratch.save(_per_node(nodes, _forest(similarity), "node long, a binary, b binary", ["node", "a", "b"], [pa.int64(), pa.binary(), pa.binary()]), "candidates")
    pairs = found.select("a", "b").distinct()
    # Full sets of the classes concerned, each from one of its texts.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "sample"), "class")
    sets = scratch.save(_sets_of(rows, wanted, shingle), "sets")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    tried = scratch.save(in_arrow(both.select("a", "b", "x", "y"), _confirm(percent), "a binary, b binary, linked boolean"), "tried")
    roots = components(tried.where("linked").select("a", "b"), "a", "b", scratch, "roots")
    compared = ("a binary, b binary", ["a", "b"], [pa.binary(), pa.binary()])

    def joined(more: DataFrame, name: str) -> DataFrame:
        """Roots with more links: what is connected already is a star."""
        return components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b", scratch, name)

    failed = tried.where("not linked").select("a", "b")
    if not failed.isEmpty():
        open_nodes = found.join(failed, ["a", "b"], "left_semi").select("node").distinct()
        again = nodes.join(open_nodes, "node", "left_semi").join(sets, "class").join(roots.withColumnRenamed("node", "class"), "class", "left")
        again = again.select("node", "class", "shingles", F.coalesce("root", "class").alias("root"))
        roots = joined(_per_node(again, _exhaustive(percent), *compared), "roots-again")
    scratch.drop("candidates", "tried", "sets")
    across = scratch.save(_across_blocks(nodes, roots, small), "across")
    if not across.isEmpty():
        wanted = across.select("class").distinct().join(classes.select("class", "sample"), "class")
        across = across.join(scratch.save(_sets_of(rows, wanted, shingle), "sets"), "class").select("node", "class", "shingles", "root")
        roots = joined(_per_node(across, _exhaustive(percent), *compared), "roots-across")
        scratch.drop("sets")
    scratch.drop("nodes", "across")
    roots = roots.withColumnRenamed("node", "class")
    placed = classes.select("class", "first", "copies").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    labels = placed.join(least, "root").select("class", "copies", "component")
    out = sketched.select("id", "n", "class").join(labels, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id").eqNullSafe(component), F.lit(False)).alias("kept"), "class", F.coalesce("copies", F.lit(1)).alias("copies"))
