"""Near-duplicate documents by order MinHash, with candidates verified by banded alignment.

A document is the sequence of its word shingles, each labelled with how often it came before. A sketch takes the
SAMPLED labelled shingles with the least hashes and keeps them in text order, so it survives edits that leave most
shingles and their order in place. Documents that share one of SKETCHES sketches are candidates; an alignment of their
words, in the band that the threshold allows, decides, so that an edited word costs one word and not five shingles.

Documents with the same words are one node from the start. First every node meets the most central node of its
buckets, the one with the most neighbours: copies of one text mostly resemble it more than each other, so a group
becomes one component with one pair per node. What is left are nodes of different components in a bucket. One-bit
minwise signatures of their words bound what an alignment can reach; they are compared inside the join, and every pair
that could reach the threshold is verified, in the smallest bucket that it shares.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tablekit.functions.components import connected_components
from tablekit.llm.common import col, documents, free_worker_cache, map_slices, slices, small_batches, stored

#: Words in a shingle, least similarity, sketches of a document, labelled shingles in a sketch.
SHINGLE, SIMILARITY, SKETCHES, SAMPLED = 5, 0.8, 20, 3
#: 64-bit words of a signature, and the standard errors below the threshold down to which its estimate is verified.
SIGNATURE, DOUBT = 16, 4.0
#: Bits of the field that says which ids may be wanted.
SIEVE = 1 << 24
#: Words off the diagonal in the first band of an alignment, and words of a text whose places are held as one number each.
BAND, SHORT = 48, 8_192
#: Shingles hashed at a time for the sketches of one document.
_BLOCK = 1 << 14
_WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20_240)
#: One odd factor and one term per sketch: multiply-add hashing of 64-bit labels.
FACTORS = _RNG.integers(1 << 62, size=SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RNG.integers(1 << 63, size=SKETCHES, dtype=np.uint64)
BIT_FACTORS = _RNG.integers(1 << 62, size=64 * SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, end to end, and where each text begins among them."""
    lists = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    coded = pc.dictionary_encode(lists.flatten())
    edge = lists.offsets.to_numpy().astype(np.int64)
    edge = edge - edge[0]
    chunk = coded.indices.to_numpy()
    own = [_WORD.findall(c.lower()) for c in coded.dictionary.to_pylist()]
    n_own = np.fromiter(map(len, own), np.int64, len(own))
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in own for w in ws), np.uint64, int(n_own.sum()))
    n = n_own[chunk]
    begin = np.cumsum(n) - n
    at = np.repeat((np.cumsum(n_own) - n_own)[chunk] - begin, n) + np.arange(int(n.sum()))
    return flat[at], np.concatenate((begin, [int(n.sum())]))[edge]


def labelled_shingles(texts: pa.Array, words: tuple[np.ndarray, np.ndarray] | None = None, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Per text the 64-bit labels of its shingles with their occurrence, in order. A text of fewer words than a shingle
    is one shingle, a text without words has none. words: the word_hashes of the texts, where they are known."""
    word, edge = words or word_hashes(texts)
    size = np.diff(edge)
    count = np.where(size > 0, np.maximum(size - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(size)), count)
    at = np.repeat(edge[:-1] - (np.cumsum(count) - count), count) + np.arange(len(doc))
    h = np.zeros(len(doc), np.uint64)
    padded = np.concatenate((word, np.zeros(shingle, np.uint64)))
    for k in range(shingle):
        inside = at + k < edge[1:][doc]
        h = np.where(inside, _mix(h * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]), h)
    order = np.lexsort((h, doc))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])))[: len(h)]
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    seen = np.zeros(len(h), np.uint64)
    seen[order] = run
    labels = _mix(h + seen * np.uint64(0xD1B54A32D192ED03))
    stop = np.cumsum(count)
    return [labels[b - n : b] for b, n in zip(stop.tolist(), count.tolist())]


def sketches(labels: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the SAMPLED labels that are least under its own hashing, in text order."""
    if not len(labels):
        return np.zeros(0, np.int64)
    keep = None
    for k in range(0, len(labels), _BLOCK):
        part = labels[k : k + _BLOCK]
        value = part[:, None] * FACTORS + TERMS
        value ^= value >> np.uint64(32)
        m = min(SAMPLED, len(part))
        at = np.argpartition(value, m - 1, axis=0)[:m] if len(part) > m else np.tile(np.arange(m)[:, None], (1, SKETCHES))
        best = np.take_along_axis(value, at, axis=0), at + k
        keep = best if keep is None else tuple(np.concatenate(x) for x in zip(keep, best))
    value, at = keep
    order = np.argsort(value, axis=0, kind="stable")[: min(SAMPLED, len(labels))]
    places = np.sort(np.take_along_axis(at, order, axis=0), axis=0)
    h = np.arange(SKETCHES, dtype=np.uint64)
    for row in places:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + labels[row])
    return h.view(np.int64)


def signature(labels: np.ndarray) -> np.ndarray:
    """One bit for each of 64 * SIGNATURE minwise hashes, packed in 64-bit words."""
    least = None
    for k in range(0, len(labels), 1 << 10):
        part = (labels[k : k + (1 << 10), None] * BIT_FACTORS).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    bits = np.zeros(64 * SIGNATURE, bool) if least is None else (_mix(least) & np.uint64(1)).astype(bool)
    return np.packbits(bits).view("<i8")


def most_unequal_bits(least: float = SIMILARITY) -> int:
    """Bits that signatures of texts at the threshold may differ in: equal with chance (1 + similarity) / 2 each."""
    n, differ = 64 * SIGNATURE, (1 - least) / 2
    return int(np.ceil(n * differ + DOUBT * np.sqrt(n * differ * (1 - differ))))


def _aligned(a: list[int], b: list[int], band: int) -> int:
    """Most words that an alignment within `band` of the diagonal pairs up.

    A row of the table is one number whose zero bits are the places where the count of paired words rises; the number
    holds the places of the band only and moves along with it.
    """
    places = defaultdict(list)
    for i, x in enumerate(a):
        places[x].append(i)
    short = len(a) <= SHORT
    masks = {x: sum(1 << i for i in own) for x, own in places.items()} if short else {}
    low, high, row, paired = 0, min(len(a), band), 0, 0
    row = (1 << high) - 1
    for j, y in enumerate(b):
        stop = min(len(a), j + band + 1)
        if stop > high:
            row |= ((1 << (stop - high)) - 1) << (high - low)
            high = stop
        start = min(max(0, j - band), high)
        if start > low:
            paired += start - low - (row & ((1 << (start - low)) - 1)).bit_count()
            row >>= start - low
            low = start
        if short:
            hit = masks.get(y, 0) >> low
        else:
            own = places.get(y, ())
            hit = sum(1 << (i - low) for i in own[bisect_left(own, low) : bisect_left(own, high)])
        hit &= row
        if hit:
            row = ((row + hit) | (row - hit)) & ((1 << (high - low)) - 1)
    return paired + high - low - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned words over all words of two texts, given as hashes in order; 0 when below `least`.

    An alignment that reaches the threshold leaves at most (1 - least) / (1 + least) of all words alone, and no aligned
    pair is further off the diagonal than that. Narrower bands come first: the alignment of a band is the best one if it
    leaves no more words alone than the band is wide.
    """
    total = len(a) + len(b)
    if not total:
        return 0.0
    widest = int(total * (1 - least) / (1 + least) + 1e-9)
    if abs(len(a) - len(b)) > widest:
        return 0.0
    # What both begin and end with is aligned.
    most = min(len(a), len(b))
    ahead = np.flatnonzero(a[:most] != b[:most])
    head = int(ahead[0]) if len(ahead) else most
    behind = np.flatnonzero(a[len(a) - most + head :][::-1] != b[len(b) - most + head :][::-1])
    tail = int(behind[0]) if len(behind) else most - head
    x, y = (v[head : len(v) - tail].tolist() for v in (a, b))
    band = min(max(abs(len(x) - len(y)), BAND), widest)
    while True:
        n = head + tail + _aligned(x, y, band)
        if band == widest or total - 2 * n <= band:
            break
        band = min(4 * band, widest)
    score = n / (total - n)
    return score if score >= least - 1e-12 else 0.0


def _node(text: str, labels_of_words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(labels_of_words.tobytes() if len(labels_of_words) else b"=" + text.encode("utf-8"))


def _nodes(texts: pa.Array, words: tuple[np.ndarray, np.ndarray] | None = None) -> list[bytes]:
    """What documents with the same words share; without words, documents with the same text."""
    word, edge = words or word_hashes(texts)
    return [_node(t, word[a:b]) for t, a, b in zip(texts.to_pylist(), edge[:-1].tolist(), edge[1:].tolist())]


def _signed(df: DataFrame) -> DataFrame:
    """(doc_id, node, sketches) for every document."""

    def work(batch: pa.RecordBatch) -> dict:
        free_worker_cache()
        texts = batch.column("text")
        words = word_hashes(texts)
        return {"doc_id": batch.column("doc_id"), "node": _nodes(texts, words), "sketches": [sketches(x) for x in labelled_shingles(texts, words)]}

    return map_slices(documents(small_batches(df)), work, "doc_id long, node binary, sketches array<long>", most=1_000_000)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (a, b) of pairs whose texts (node, text) are similar enough."""

    def run(batches):
        for batch in batches:
            for part in slices([batch], "text_a", 1_000_000):
                seen: dict[bytes, int] = {}
                rows = []
                for side in ("a", "b"):
                    nodes = part.column(side).to_pylist()
                    rows.append([seen.setdefault(n, len(seen)) for n in nodes])
                distinct: list = [None] * len(seen)
                for side, own in zip(("a", "b"), rows):
                    column = part.column(f"text_{side}")
                    for k, i in enumerate(own):
                        if distinct[i] is None:
                            distinct[i] = column[k].as_py()
                word, edge = word_hashes(pa.array(distinct, pa.large_string()))
                words = [word[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
                good = [similarity(words[i], words[j], least) > 0 for i, j in zip(*rows)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct unordered (a, b) of different nodes."""
    return rows.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sieved(df: DataFrame, name: str, wanted: DataFrame, other: str) -> tuple[DataFrame, DataFrame]:
    """df as the rows whose id may be wanted, and the rows whose id surely is not: those need no join, and their texts no
    shuffle. The wanted ids set bits of a field of SIEVE bits, which is all that is broadcast, however many there are."""

    def place(c: str) -> str:
        return f"pmod(xxhash64({c}), {SIEVE})"

    word, bits = _fresh(df, "word", "bits")
    field = wanted.select(F.expr(f"shiftright({place(other)}, 6)").alias(word), F.expr(f"shiftleft(1L, cast({place(other)} % 64 as int))").alias(bits))
    field = field.groupBy(word).agg(F.bit_or(bits).alias(bits))
    held = df.join(F.broadcast(field), F.expr(f"shiftright({place(f'`{name}`')}, 6) = {word}"), "left")
    is_set = F.expr(f"coalesce(shiftright({bits}, cast({place(f'`{name}`')} % 64 as int)) & 1L, 0L) = 1L")
    fields = [col(c) for c in df.columns]
    return held.filter(is_set).select(*fields), held.filter(~is_set).select(*fields)


def _fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df has not, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"{stem}_{k}" for k in range(len(taken) + 1)) if n not in taken) for stem in stems]


def _texts(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text, bits) for the wanted(node, doc_id): one document of each node."""

    def name(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "node": _nodes(batch.column("text")), "text": batch.column("text")}

    def sign(batch: pa.RecordBatch) -> dict:
        words = word_hashes(batch.column("text"))
        bits = [signature(x) for x in labelled_shingles(batch.column("text"), words, 1)]
        return {"node": batch.column("node"), "text": batch.column("text"), "bits": bits}

    # Rows may share an id, or have none: ids only say which rows to look at, the words say which is meant.
    ids = wanted.select(F.col("doc_id").alias("d")).distinct()
    named = map_slices(_sieved(documents(df), "doc_id", ids, "d")[0], name, "doc_id long, node binary, text string", most=1_000_000)
    meant = wanted.select(F.col("node").alias("n"), F.col("doc_id").alias("d"))
    named = named.join(meant, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    signed = map_slices(named.dropDuplicates(["node"]).select("node", "text"), sign, "node binary, text string, bits array<long>", most=1_000_000)
    return stored(signed, "near-texts")


def _components(df: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """(id, component) for the nodes that share a bucket with another one."""
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sketches").alias("sketches"))
    rows = nodes.select("node", "doc_id", F.explode("sketches").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    rows = stored(rows.join(shared, "bucket"), "near-buckets")
    texts = _texts(df, rows.select("node", "doc_id").distinct())
    # The node of a bucket with the most neighbours over all buckets; each node meets the most central one of its own.
    degrees = rows.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = rows.select("bucket", "node").join(degrees, "node")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("hub"))
    nearest = ranked.join(hubs, "bucket").filter(F.col("hub.node") != F.col("node")).groupBy("node").agg(F.max("hub").alias("hub"))
    pairs = stored(_pairs(nearest.select(F.col("hub.node").alias("x"), F.col("node").alias("y"))), "near-pairs")
    links = stored(_verified(pairs, texts, least), "near-links")
    members = texts.select(F.col("node").alias("id"))
    components = stored(connected_components(members, links), "near-components")
    placed = rows.select("bucket", "node").join(components.withColumnRenamed("id", "node"), "node")
    split = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
    known = nodes.select("node", F.array_sort("sketches").alias("sketches"))
    placed = stored(placed.join(split, "bucket").join(texts.select("node", "bits"), "node").join(known, "node"), "near-open")
    unequal = sum((F.bit_count(F.col("p.bits")[k].bitwiseXOR(F.col("q.bits")[k])) for k in range(SIGNATURE)), F.lit(0))
    apart = (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.component") != F.col("q.component"))
    # A pair counts in the smallest bucket that it shares.
    once = F.array_min(F.array_intersect("p.sketches", "q.sketches")) == F.col("p.bucket")
    met = placed.alias("p").join(placed.alias("q"), apart & (unequal <= most_unequal_bits(least)) & once)
    # A node that met the other one as its hub is verified already.
    more = _pairs(met.select(F.col("p.node").alias("x"), F.col("q.node").alias("y"))).join(pairs, ["a", "b"], "left_anti")
    found = stored(_verified(more, texts, least), "near-links")
    if found.isEmpty():
        return components
    # Links between components, over which they unite.
    named = components.select(F.col("id").alias("n"), F.col("component").alias("c"))
    between = found.join(named.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(named.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b")
    whole = connected_components(named.select(F.col("c").alias("id")).distinct(), between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    whole = whole.withColumnRenamed("component", "whole").withColumnRenamed("id", "component")
    return stored(components.join(whole, "component").select("id", F.col("whole").alias("component")), "near-components")


def _classes(df: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every document, and (node, component, class_id, class_size) of every node."""
    signed = stored(_signed(df), "near-signed")
    components = _components(df, signed, least).select(F.col("id").alias("node"), "component")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"))
    named = nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("size").alias("class_size"))
    return signed.select("doc_id", "node"), named.select("node", "component").join(whole, "component")


def near_duplicates(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, representative) for every row of df(doc_id, text).

    Two documents are linked when they have the same words, or when they share a sketch of five-word shingles and their
    aligned words are at least `least` of all their words; classes are the connected components. class_id is the smallest id of the class,
    and the document that has it is the representative. Case, punctuation and white space do not count. Texts without
    words (null counts as empty) are linked to equal texts only. Repeated rows are members like others; a null id is
    never the smallest, and a class of null ids alone has a null class_id and no representative. An empty table
    gives an empty table.
    """
    rows, classes = _classes(df, least)
    out = rows.join(classes, "node")
    return out.select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("representative"))


def without_near_duplicates(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of df(doc_id, text, ...) for each class of near_duplicates, with all its columns: that with the
    smallest id, of repeated rows one. Of a class of null ids alone one row stays."""
    rows, classes = _classes(df, least)
    mine = F.col("doc_id").eqNullSafe(F.col("class_id"))
    keep = rows.join(classes, "node").filter(mine).groupBy("component").agg(F.min(F.struct("node", "doc_id")).alias("k"))
    fields = df.columns
    name, keep_node, keep_id = _fresh(df, "node", "keep_node", "keep_id")
    keep = stored(keep.select(F.col("k.node").alias(keep_node), F.col("k.doc_id").alias(keep_id)), "near-kept")
    mine = col("doc_id").cast("long").eqNullSafe(F.col(keep_id))
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        # Ids tell rows apart: those that go are fewer than those that stay.
        kept = F.col("doc_id").eqNullSafe(F.col(keep_id))
        gone = stored(rows.select("doc_id").join(keep.select(keep_id), kept, "left_anti").withColumnRenamed("doc_id", keep_id), "near-gone")
        own = df.withColumn(keep_node, col("doc_id").cast("long"))
        may, stay = _sieved(own, keep_node, gone, keep_id)
        left = may.join(gone, F.col(keep_node).eqNullSafe(F.col(keep_id)), "left_anti")
        return left.unionByName(stay).select(*[col(c) for c in fields])
    # Rows share ids: they are told apart by their words.
    ids = keep.select(F.col(keep_id)).distinct()

    def run(batches):
        for part in slices(batches):
            texts = pc.fill_null(part.column("text"), "")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_nodes(texts), pa.binary())], names=[*part.schema.names, name])

    keyed = df.join(ids, mine, "left_semi").mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())]))
    out = keyed.join(keep.select(keep_node, keep_id), (F.col(name) == F.col(keep_node)) & mine, "left_semi").dropDuplicates([name])
    return out.select(*[col(c) for c in fields])
