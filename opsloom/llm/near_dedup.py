"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of five-word shingles gets a signature of 48 b-bit symbols
(b = 16), cut into 12 chunks of four. By the pigeonhole principle, two
signatures that differ in at most 23 symbols have a chunk with at most one
differing symbol; so each chunk is entered once for each of the four symbols
that may differ, and signatures that meet under such a key are candidates,
however many symbols differ elsewhere. A pair of similarity 0.75 differs in 12
symbols on average; it meets in a chunk with probability 0.738 (0.75^4 + 4 x
0.75^3 x 0.25), and in none of the 12 with 1e-7. That search is all that can
miss a link: what follows looks at the full sets.

Documents with equal sets are one class. Candidates are confirmed on full sets,
unless bitmaps of the sets already differ in more places than linked sets can.
Under a crowded key, every member meets the one that shares crowded keys with the
most others, such as the text that the others are copies of. Under a key with few
members, all pairs are candidates that aren't in one component by then. Where
members of a crowded key stay apart, they meet one outside the largest component.
What is still apart is compared exactly by shared rare shingles: with shingles in
one order, rarest first, linked sets share one of the first ones of both. Lists of
members under a shingle pair only members of different components, and the largest
component of a list only with the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import durable, free_names, lean, table
from .textarrow import SPACED_LOWER, mix, ngrams, text_blocks, words

U = np.uint64
SHINGLE = 5
CHUNKS, PER_CHUNK = 12, 4
SYMBOLS = CHUNKS * PER_CHUNK
#: Members of a key up to which all pairs are candidates at once; beyond it, blocks.
CROWD = 32
#: Identifiers up to which a list of wanted documents is broadcast; beyond it, the join shuffles.
BROADCAST_IDS = 200_000
#: 64-bit words of a set's bitmap.
BITMAP = 16
#: Cells that count shingles of crowds by hash; they only order shingles, and are all that the driver gets.
CELLS_BITS = 20
#: Rows, pairs for one, and bytes of their texts, whose sets are held at a time.
PAIRS, PAIR_BYTES = 512, 4 << 20

_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(text, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column."""
    out = []
    for block in text_blocks(text):
        grams, bounds = ngrams(words(block, SPACED_LOWER), size)
        out += [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of 48 16-bit symbols for each set; all sets have members."""
    out = np.empty((len(bounds) - 1, SYMBOLS), np.uint16)
    for k, seed in enumerate(_SEEDS):
        x = flat * seed
        x ^= x >> U(31)
        x *= U(0xBF58476D1CE4E5B9)
        out[:, k] = mix(np.minimum.reduceat(x, bounds[:-1])) >> U(48)
    return out


def bitmaps(flat: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One row of BITMAP words for each set flat[cut[i] : cut[i + 1]]: the bits that hashes of its shingles name."""
    bits = np.zeros((len(cut) - 1, 64 * BITMAP), bool)
    bits[np.repeat(np.arange(len(cut) - 1), np.diff(cut)), (mix(flat ^ U(0x94D049BB133111EB)) % U(64 * BITMAP)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def _sketch(id_col: str, text_col: str, *carried: str):
    def run(batches):
        for batch in batches:
            ids, text, *other = (batch.column(batch.schema.get_field_index(c)) for c in (id_col, text_col, *carried))
            for block in text_blocks(text, most=1 << 14):
                grams, bounds = ngrams(words(block, SPACED_LOWER), SHINGLE)
                sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sig, one, two = [None] * len(sets), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                maps = np.zeros((len(sets), BITMAP), np.int64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    cut = np.concatenate([[0], np.cumsum(n[full])])
                    for i, s in zip(full.tolist(), signatures(flat, cut), strict=True):
                        sig[i] = s.tobytes()
                    one[full] = np.add.reduceat(mix(flat), cut[:-1]).view(np.int64)
                    two[full] = np.bitwise_xor.reduceat(mix(flat ^ U(0x5851F42D4C957F2D)), cut[:-1]).view(np.int64)
                    maps[full] = bitmaps(flat, cut)
                rows = slice(block.first, block.first + len(sets))
                names = ["doc_id", "n_shingles", "set_a", "set_b", "sig", *_MAP, *carried]
                yield pa.RecordBatch.from_arrays([ids[rows].cast(pa.int64()), pa.array(n), pa.array(one), pa.array(two), pa.array(sig, pa.binary()), *(pa.array(maps[:, k].copy()) for k in range(BITMAP)), *(c[rows] for c in other)], names=names)

    return run


_MAP = [f"w{k}" for k in range(BITMAP)]
_WORDS = ", ".join(f"{w} long" for w in _MAP)
_SKETCH = f"doc_id long, n_shingles long, set_a long, set_b long, sig binary, {_WORDS}"


def _can_link() -> Column:
    """Whether sets of n_a and n_b shingles with bitmaps map_a and map_b can be linked.

    Linked sets differ in size by a quarter at most, and in a seventh of both their
    shingles; each bit that differs is another of these.
    """
    bits = sum((F.bit_count(F.col(f"map_a.{w}").bitwiseXOR(F.col(f"map_b.{w}"))) for w in _MAP), F.lit(0))
    return (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")) & (7 * bits <= F.col("n_a") + F.col("n_b"))


def _keys(batches):
    """Each class under its 48 keys: chunk, the symbol that may differ, and the other three."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, PER_CHUNK).astype(np.int64)
        for skip in range(PER_CHUNK):
            a, b, c = (sig[:, :, j] for j in range(PER_CHUNK) if j != skip)
            tag = np.arange(CHUNKS, dtype=np.int64) * PER_CHUNK + skip
            key = (tag[None, :] << 48) | (a << 32) | (b << 16) | c
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids, CHUNKS))], names=["key", "node"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.75 or more."""
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return bool(both) and 100 * both >= 75 * (len(x) + len(y) - both)


def parts(batches, *texts: int):
    """The batches in slices of at most PAIRS rows, and of PAIR_BYTES in the columns `texts` unless one row has more."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
        upto, i = np.cumsum(size), 0
        while i < batch.num_rows:
            j = min(i + PAIRS, max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + PAIR_BYTES))))
            yield batch.slice(i, j - i)
            i = j


def _confirm(batches):
    """Pairs (a, b) whose full sets are linked."""
    for part in parts(batches, 2, 3):
        left, right = shingle_sets(part.column(2)), shingle_sets(part.column(3))
        good = pa.array([linked(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])


def _row_key() -> Column:
    """Digest of the text: with the identifier, the key of a row. Rows that share both are equal and get the same."""
    return F.xxhash64("text")


def _text_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id (the class), text: one text for each row (doc_id, rep_id, rep_hash) of `classes`, whose key is that of its first row."""
    wanted = durable(classes)
    few = wanted.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").alias("_id"), _row_key().alias("_hash"), "text")
    found = rows.join(F.broadcast(wanted) if few else wanted, F.col("_id").eqNullSafe(F.col("rep_id")) & (F.col("_hash") == F.col("rep_hash")))
    # Rows of the same identifier and text are one row here.
    return found.groupBy("doc_id").agg(F.any_value("text").alias("text"))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - CELLS_BITS)).astype(np.int64)


def _count_cells(batches):
    """How many shingles of the texts fall into each cell."""
    total = np.zeros(1 << CELLS_BITS, np.int64)
    for part in parts(batches, 0):
        for own in shingle_sets(part.column(0)):
            np.add.at(total, _cells(own), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])


def rare_first(own: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of a set that a link to a set of its size or smaller must share, rarest first, and how many a link to one of its size or larger must.

    Sets of n and m shingles are linked if they share 3/7 of n + m or more. Of n
    in a fixed order, all but n - k + 1 can go if k are shared: with m >= n, k is
    6n/7 or more, with m <= n it is 3n/4 or more.
    """
    n = len(own)
    order = np.lexsort((own, frequency[_cells(own)]))
    return own[order[: n - (3 * n + 3) // 4 + 1]], n - (6 * n + 6) // 7 + 1


def _entries(frequency):
    def run(batches):
        for batch in parts(batches, 2):
            node, component, *maps = (batch.column(i).to_numpy() for i in (0, 1, *range(3, 3 + BITMAP)))
            sets = shingle_sets(batch.column(2))
            made = [rare_first(own, frequency.value) for own in sets]
            k = np.array([len(first) for first, _ in made], np.int64)
            if not k.sum():
                continue
            place = np.concatenate([np.arange(n) for n in k])
            short = place < np.repeat([s for _, s in made], k)
            size = np.array([len(own) for own in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([first for first, _ in made]).view(np.int64)), *(pa.array(np.repeat(x, k)) for x in (node, component, size)), pa.array(short), pa.array(size.repeat(k) - place), *(pa.array(np.repeat(x, k)) for x in maps)], names=["shingle", "node", "component", "n", "short", "rest", *_MAP])

    return run


def _crowd_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs of different components among (node, component, text, and the bitmap's words), by rare shingles that they share."""
    spark = members.sparkSession
    counted = members.select("text").mapInArrow(lean(_count_cells), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << CELLS_BITS, np.int64)
    frequency[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    entries = durable(members.select("node", "component", "text", *_MAP).mapInArrow(lean(_entries(spark.sparkContext.broadcast(frequency))), "shingle long, node long, component long, n long, short boolean, rest long, " + _WORDS))
    per = entries.groupBy("shingle", "component").agg(F.count("*").alias("k"), F.max("short").alias("short"))
    lists = durable(per.groupBy("shingle").agg(F.count("*").alias("of"), F.max_by("component", F.struct("k", "component")).alias("main"), F.max("short").alias("short")).where("of > 1 AND short").select("shingle", "main"))
    entries = durable(entries.join(lists, "shingle").select("shingle", "node", "component", "n", "short", "rest", *_MAP, (F.col("component") != F.col("main")).alias("outside")))

    def meet(small: Column, large: Column) -> DataFrame:
        """Pairs of a smaller set, by the few shingles that it must share with one of its size or larger, and the larger one.

        Under the first shingle that linked sets share, what follows in both is enough for all that they share.
        """
        side = lambda n: ("shingle", F.col("node").alias(n), F.col("component").alias(f"c_{n}"), F.col("n").alias(f"n_{n}"), F.col("rest").alias(f"rest_{n}"), F.struct(*_MAP).alias(f"map_{n}"))
        x, y = entries.where(F.col("short") & small).select(*side("a")), entries.where(large).select(*side("b"))
        return x.join(y, "shingle").where((F.col("c_a") != F.col("c_b")) & (F.col("n_a") <= F.col("n_b")) & (7 * F.least("rest_a", "rest_b") >= 3 * (F.col("n_a") + F.col("n_b"))) & _can_link()).select("a", "b")

    found = meet(F.col("outside"), F.lit(True)).unionByName(meet(~F.col("outside"), F.col("outside")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of every document under Jaccard >= 0.75 of five-word shingle sets.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than five words is one shingle. Returns doc_id, n_shingles, component_id
    (smallest identifier reachable over links), kept, and class_id (smallest
    identifier with the same set). A null, empty or wordless text has an empty
    set and is linked with nothing. Each row stands for itself: rows that share
    an identifier are returned each, with the component of their own text, and
    all kept when theirs is the smallest identifier of it. A null identifier is
    larger than any other. An empty table gives an empty result; other columns
    are not looked at.
    """
    return _components_by_row(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("row_hash")


def _confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are linked."""
    side = lambda n: reps.select(F.col("doc_id").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.struct(*_MAP).alias(f"map_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = durable(both.where(_can_link()).select("a", "b"))
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = durable(_text_of(docs, ids.join(reps.select("doc_id", "rep_id", "rep_hash"), "doc_id")))
    side = lambda n: texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"text_{n}"))
    return durable(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(lean(_confirm), "a long, b long").distinct())


def _merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links: the graph of the new links has components for nodes."""
    if links.isEmpty():
        return of
    own = lambda n: of.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}"))
    between = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = durable(components(between))
    whole = of.unionByName(joined.select("node", F.col("node").alias("component"))).distinct()
    return durable(whole.join(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select("node", F.coalesce("joined", "component").alias("component")))


def _central() -> Column:
    """Aggregate: the node with the largest degree; of equals, the smallest."""
    return F.max_by("node", F.struct("degree", -F.col("node")))


def _components_by_row(docs: DataFrame) -> DataFrame:
    """What near_duplicates gives for (doc_id, text), and row_hash, the text's half of the row key.

    Inside, a node is a class of equal sets, under a number of its own that the checkpoint holds.
    """
    keyed = docs.withColumn("row_hash", _row_key())
    made = durable(keyed.mapInArrow(lean(_sketch("doc_id", "text", "row_hash")), f"{_SKETCH}, row_hash long"))
    sets = made.where("n_shingles > 0")
    of_class = sets.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows"), F.first(F.struct("sig", *_MAP, F.col("doc_id").alias("rep_id"), F.col("row_hash").alias("rep_hash"))).alias("rep"))
    classes = durable(of_class.select("n_shingles", "set_a", "set_b", "class_id", "rows", "rep.*", F.monotonically_increasing_id().alias("node")))
    reps = classes.select(F.col("node").alias("doc_id"), "sig", *_MAP, "n_shingles", "rep_id", "rep_hash")

    keys = reps.select("doc_id", "sig").mapInArrow(lean(_keys), "key long, node long")
    sizes = durable(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = durable(keys.join(sizes, "key"))
    crowded = met.where(F.col("n") > CROWD)
    crowded = durable(crowded.select("key", "node").join(durable(crowded.groupBy("node").agg(F.sum("n").alias("degree"))), "node"))
    star = lambda members, centres: members.join(durable(centres), "key").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).where("a < b").distinct()
    labelled = lambda rows, of: rows.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = durable(components(_confirmed(docs, reps, star(crowded, crowded.groupBy("key").agg(_central().alias("centre"))))))

    few = labelled(met.where(F.col("n") <= CROWD), of).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "component"))).alias("m"))
    later = lambda x, i: F.filter(F.slice("m", i + 2, CROWD), lambda y: y["component"] != x["component"])
    pairs = few.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))).alias("p")).select("p.a", "p.b")
    of = _merged(of, _confirmed(docs, reps, pairs.distinct()))

    for exactly in (False, True):
        members = labelled(crowded, of)
        per = members.groupBy("key", "component").agg(F.count("*").alias("k"), F.max("degree").alias("degree"), _central().alias("node"))
        split = durable(per.groupBy("key").agg(F.count("*").alias("of"), F.max_by("component", F.struct("k", "component")).alias("main")).where("of > 1"))
        if split.isEmpty():
            break
        if exactly:
            apart = durable(members.join(split, "key").select("node", "component").distinct())
            whole = apart.join(reps.select(F.col("doc_id").alias("node"), *_MAP, "rep_id", "rep_hash"), "node")
            texts = _text_of(docs, whole.select(F.col("node").alias("doc_id"), "rep_id", "rep_hash")).withColumnRenamed("doc_id", "node")
            more = _crowd_pairs(durable(whole.join(texts, "node").select("node", "component", "text", *_MAP)))
        else:
            more = star(members, per.join(split, "key").where("component <> main").groupBy("key").agg(_central().alias("centre")))
        of = _merged(of, _confirmed(docs, reps, more))

    named = classes.select("n_shingles", "set_a", "set_b", "class_id", "rows", "node").join(of, "node", "left")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("class_id").alias("component_id"))
    # A class of one row without links needs no name: its row stands for itself.
    named = named.where("rows > 1 OR component IS NOT NULL").join(least, "component", "left")
    named = durable(named.select("n_shingles", "set_a", "set_b", "class_id", F.when(F.col("component").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id"), F.lit(True).alias("named")))
    found = made.join(named, ["n_shingles", "set_a", "set_b"], "left")
    own = lambda c: F.when(F.col("named"), F.col(c)).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", own("component_id").alias("component_id"), own("component_id").eqNullSafe(F.col("doc_id")).alias("kept"), own("class_id").alias("class_id"), "row_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays: that with the smallest identifier.

    Of rows that share an identifier each is judged by its own text; where several share the kept one, all of them stay.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own_id, own_hash = free_names(docs, "kept_id", "kept_hash")
    kept = _components_by_row(rows).where("kept").select(F.col("doc_id").alias(own_id), F.col("row_hash").alias(own_hash)).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash)), "left_semi")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all of `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS s FROM w WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept,
  coalesce(class_id, doc_id) AS class_id
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM (SELECT doc_id, list_sort(list(g)) AS gs FROM sh GROUP BY 1)) USING (doc_id)
"""
