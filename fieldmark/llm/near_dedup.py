"""MinHash near-dedup with b-bit MinHash signatures.

A document is the set of its distinct word shingles.  Every set gets 240
minima; bands of 5 of them make bucket keys, and the low 4 bits of each are
packed into a 120-byte signature.

1.  Equal sets are one set from here on, so exact copies add nothing.
2.  Buckets with two sets or more are kept, of those with the same members one.
    Equal bits of two signatures, corrected for chance, estimate the similarity
    of two members; those that may reach the threshold are linked.
3.  Components of these links part the sets into groups.  A group's texts meet,
    and links are confirmed on the full sets.
4.  Components of the confirmed links are the result.

Buckets and groups are linked by :func:`linked`: one beyond a size is dealt
into blocks, each with the group's leader besides.  What is connected with the
leader needs no other comparison; only the rest of a block visits the other
blocks.  A group of copies of one text costs one comparison a member, no task
holds more than a block and its visitors, and no pair is left out.

Two sets at similarity 0.85 share no bucket with probability 6e-13, at 0.8
5e-9; the estimate may err by six standard deviations before a pair is lost.

Null text, or text without words: the empty set, linked with nothing. Null
ids: linked with nothing, component null, kept. Rows with the same id and set
are one document and have the same result. An empty table gives no rows. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.components import components
from fieldmark.llm.frames import doc_text, free_name, give_back, join_groups, maybe_in, pieces, settle
from fieldmark.llm.words import WordHashes, lower_words, mixed, shingle_hashes

_SLICE = 256
_NIBBLES = np.uint64(0x1111111111111111)


@dataclass(frozen=True)
class Similar:
    """Links have ``100 * intersection >= percent * union`` over shingles of ``width`` words."""

    width: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 5
    block_sets: int = 20_000
    block_shingles: int = 2_000_000
    block_docs: int = 4_000
    margin: float = 6.0

    @property
    def size(self) -> int:
        return self.bands * self.rows  # minima; a multiple of 16 packs into whole words

    def least_matches(self) -> int:
        """Equal 4-bit values from which a pair may be similar."""
        t = self.percent / 100
        t = max(0.0, t - self.margin * math.sqrt(t * (1 - t) / self.size))
        return math.floor((t + (1 - t) / 16) * self.size)


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(known.of(lower_words(text)), width))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.uint64(2**64 - 1))
    for a in range(0, len(shingles), _SLICE):
        np.minimum(least, np.multiply.outer(factors, shingles[a : a + _SLICE]).min(1), out=least)
    return least


def factors(n: int) -> np.ndarray:
    return np.random.default_rng(8).integers(1, 2**63, n, np.uint64) << np.uint64(1) | np.uint64(1)


def packed_bits(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(low, axis=1)


def matches(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many 4-bit values of ``one`` are equal in each row of ``many``."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return many.shape[1] * 16 - np.bitwise_count(x & _NIBBLES).sum(1, dtype=np.int64)


def signatures(docs: DataFrame, how: Similar) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, digest and node (128 and 64 bits) of the set, bands, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by = WordHashes(), factors(how.size)
        salt = mixed(np.arange(1, how.bands + 1, dtype=np.uint64) << np.uint64(32))
        names = ["doc_id", "mark", "n_shingles", "digest", "node", "bands", "bits"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for b in pieces(batches):
            rows = []
            for text in b.column(1):
                s = shingle_set(text.as_py(), how.width, known)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                least = minima(s, by)
                band = salt.copy()
                for part in least.reshape(how.bands, how.rows).T:
                    band = mixed(band ^ part)
                d = digest(s)
                rows.append((len(s), d, int.from_bytes(d[:8], "big", signed=True), band.view(np.int64).tolist(), packed_bits(least).tobytes()))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    rows = doc_text(docs).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, node long, bands array<long>, bits binary")


class _Labels:
    """Which of n things are connected, as numbers."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, j: int) -> None:
        if self.of[i] != self.of[j]:
            self.of[self.of == self.of[j]] = self.of[i]


#: Of a group's columns, as lists: makes what ``Similarity`` needs.
Read = Callable[[dict[str, list]], tuple]
#: Yields those of ``others`` that are linked with ``i``; what has become connected meanwhile may be passed over.
Similarity = Callable[[tuple, int, np.ndarray, _Labels], Iterator[int]]


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """The groups of sorted rows, one after another; a group may run over batches."""
    held, last = None, None
    for b in batches:
        columns = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
        key = list(zip(*(columns[k] for k in keys)))
        a = 0
        for z in range(1, len(b) + 1):
            if z < len(b) and key[z] == key[a]:
                continue
            part = {c: v[a:z] for c, v in columns.items()}
            if held is not None and last == key[a]:
                for c, v in part.items():
                    held[c] += v
            else:
                if held is not None:
                    yield held
                held, last = part, key[a]
            a = z
    if held is not None:
        yield held


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, (bytes, str)))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def linked(members: DataFrame, id_: str, kept: list[str], read: Read, similar: Similarity) -> tuple[DataFrame, DataFrame | None]:
    """Connects the members of each group: columns g (group), ``id_``, blocks, lead (one member leads), and what ``read``
    takes, of which ``kept`` is needed for a visit.

    Gives (``id_``, label) of every member and links (u, v) between labels of groups with several blocks, None if there
    are none.  Members are connected by similar pairs of their group if their labels are equal or connected by links."""
    kind = dict(members.dtypes)
    members = members.withColumn("home", F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int"))
    members = members.withColumn("block", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))))
    names = ["g", id_, "home", "blocks", "label", "led", *kept]
    kinds = [kind["g"], kind[id_], "int", "int", kind[id_], "boolean", *(kind[c] for c in kept)]
    arrow, label_kind = [_ARROW[k] for k in kinds], _ARROW[kind[id_]]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in _sorted_groups(batches, ["g", "block"]):
                ids, held = group[id_], read(group)
                labels, first = _Labels(len(ids)), group["lead"].index(True) if True in group["lead"] else 0
                for i in [first, *(k for k in range(len(ids)) if k != first)]:
                    others = np.flatnonzero(labels.of != labels.of[i])
                    for j in similar(held, i, others, labels) if len(others) else ():
                        labels.join(i, j)
                of = labels.of.tolist()
                name = {of[first]: ids[first]}  # the leader's part is named after it, the others after their least
                for k in sorted(range(len(ids)), key=ids.__getitem__):
                    name.setdefault(of[k], ids[k])
                for k, home in enumerate(group["home"]):
                    if home == group["block"][k]:  # the leader is at home in one block
                        several = group["blocks"][k] > 1
                        yield (group["g"][k], ids[k], home, group["blocks"][k], name[of[k]], of[k] == of[first], *(group[c][k] if several else None for c in kept))

        yield from _batches(rows(), names, arrow)
        give_back()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in _sorted_groups(batches, ["g", "block"]):
                held, labels, number = read(group), _Labels(len(group["g"])), {}
                labels.of = np.array([number.setdefault(x, len(number)) for x in group["label"]])
                at_home = np.array(group["home"]) == np.array(group["block"])
                for i in np.flatnonzero(~at_home).tolist():
                    others = np.flatnonzero(at_home & (labels.of != labels.of[i]))
                    for j in similar(held, i, others, labels) if len(others) else ():
                        labels.join(i, j)
                        yield group["label"][i], group["label"][j]

        yield from _batches(rows(), ["u", "v"], [label_kind, label_kind])
        give_back()

    dealt = members.repartition("g", "block").sortWithinPartitions("g", "block")
    done = settle(dealt.mapInArrow(within, ", ".join(f"{c} {k}" for c, k in zip(names, kinds))), "linked")
    more = done.filter("blocks > 1")
    if more.isEmpty():
        return done.select(id_, "label"), None
    guests = more.filter("not led").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block <> home")
    both = more.withColumn("block", F.col("home")).unionByName(guests).drop("led", "blocks")
    links = both.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(visits, f"u {kind[id_]}, v {kind[id_]}")
    return done.select(id_, "label"), settle(links, "links")


def _alike(how: Similar) -> tuple[Read, Similarity]:
    """Sets whose signatures are equal in so many places that they may be similar."""
    least = how.least_matches()

    def read(group: dict[str, list]) -> tuple:
        return (np.frombuffer(b"".join(group["bits"]), np.uint64).reshape(len(group["bits"]), -1),)

    def similar(held: tuple, i: int, others: np.ndarray, labels: _Labels) -> Iterator[int]:
        yield from others[matches(held[0][i], held[0][others]) >= least].tolist()

    return read, similar


def _confirmed(how: Similar) -> tuple[Read, Similarity]:
    """Sets that are similar, the likeliest by their signatures first."""
    least, known = how.least_matches(), WordHashes()

    def read(group: dict[str, list]) -> tuple:
        sets = [shingle_set(t, how.width, known) for t in group["text"]]
        return np.frombuffer(b"".join(group["bits"]), np.uint64).reshape(len(sets), -1), np.array([len(s) for s in sets]), sets

    def similar(held: tuple, i: int, others: np.ndarray, labels: _Labels) -> Iterator[int]:
        bits, size, sets = held
        others = others[(100 * np.minimum(size[others], size[i]) >= how.percent * np.maximum(size[others], size[i]))]
        n = matches(bits[i], bits[others])
        order = np.argsort(-n, kind="stable")
        for j in others[order[n[order] >= least]].tolist():
            if labels.of[i] != labels.of[j]:
                a, b = sets[i], sets[j]
                common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
                if 100 * common >= how.percent * (len(a) + len(b) - common):
                    yield j

    return read, similar


def distinct_sets(all_sig: DataFrame) -> DataFrame:
    """One row for each set: digest, node, n_shingles, bands, bits, copies, and first: the least (doc_id, mark) that has it."""
    rows = all_sig.filter("doc_id is not null and n_shingles > 0")
    often = settle(rows.groupBy("digest", "node").count().filter("count > 1").select("node"), "copies")
    # Only rows that may have copies are shuffled with what they hold.
    rows = maybe_in(rows, "node", often, "maybe").withColumn("first", F.struct("doc_id", "mark"))
    wide = ["node", "n_shingles", "bands", "bits"]
    many = rows.filter("maybe").groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in wide))
    one = rows.filter("not maybe").withColumn("copies", F.lit(1).cast("long"))
    return one.select("digest", "first", "copies", *wide).unionByName(many)


def candidate_groups(sets: DataFrame, how: Similar) -> DataFrame:
    """(node, root): the sets that share a bucket with one that they may be similar to, in groups."""
    keys = sets.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("n"), F.bit_xor("node").alias("x")).filter("hub <> top")
    # Buckets with equal members are one.
    buckets = settle(shared.groupBy("hub", "top", "n", "x").agg(F.min("key").alias("key")).select("key", "hub", "n"), "buckets")
    near = maybe_in(sets.select("node", "bits", F.explode("bands").alias("key")), "key", buckets.select("key"), "maybe").filter("maybe")
    near = join_groups(near.select("key", "node", "bits"), buckets.withColumn("blocks", F.ceil(F.col("n") / how.block_sets).cast("int")), ["key"])
    near = near.select(F.col("key").alias("g"), "node", "bits", "blocks", (F.col("node") == F.col("hub")).alias("lead"))
    of, links = linked(near, "node", ["bits"], *_alike(how))
    edges = of.select(F.col("node").alias("u"), F.col("label").alias("v"))
    return components(edges if links is None else edges.unionByName(links))


def owners(docs: DataFrame, sets: DataFrame, how: Similar) -> DataFrame:
    """(digest, owner) of the sets in candidate groups: the least (doc_id, mark) that confirmed links reach."""
    members = sets.select("digest", "node", "n_shingles", "bits", "first").join(candidate_groups(sets, how), "node")
    members = settle(members.select(F.col("root").alias("g"), "digest", "node", "n_shingles", "bits", "first"), "members")
    weight = members.groupBy("g").agg(F.sum("n_shingles").alias("all_shingles"), F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.col("all_shingles") / how.block_shingles), F.ceil(F.col("n") / how.block_docs)).cast("int")
    full = join_groups(members, weight.select("g", "n", blocks.alias("blocks")), ["g"])
    texts = doc_text(docs).withColumn("mark", F.xxhash64("text"))
    texts = maybe_in(texts, "mark", members.select("first.mark"), "maybe").filter("maybe and doc_id is not null")
    texts = texts.select(F.struct("doc_id", "mark").alias("first"), "text").groupBy("first").agg(F.first("text").alias("text"))
    full = full.join(texts, "first").select("g", "digest", "bits", "text", "blocks", (F.col("node") == F.col("g")).alias("lead"))
    of, links = linked(full, "digest", ["bits", "text"], *_confirmed(how))
    if links is not None:
        roots = components(links).select(F.col("node").alias("label"), "root")
        of = of.join(roots, "label", "left").select("digest", F.coalesce("root", "label").alias("label"))
    of = of.join(members.select("digest", "first"), "digest")
    return join_groups(of, of.groupBy("label").agg(F.min("first").alias("owner"), F.count("*").alias("n")), ["label"]).select("digest", "owner")


def _rows(docs: DataFrame, how: Similar) -> DataFrame:
    """Per row of ``docs``: doc_id, mark, n_shingles, and owner, the (doc_id, mark) of the document that stands for its
    group; null for what has neither copies nor links."""
    all_sig = settle(signatures(docs, how), "signatures")
    sets = settle(distinct_sets(all_sig), "sets")
    of_set = sets.select("digest", "node", "first", "copies").join(owners(docs, sets, how), "digest", "left").filter("copies > 1 or owner is not null")
    of_set = settle(of_set.select("digest", "node", F.coalesce("owner", "first").alias("owner"), F.col("copies").alias("n")), "owners")
    rows = maybe_in(all_sig.select("doc_id", "mark", "n_shingles", "digest", "node"), "node", of_set.select("node"), "maybe")
    some = join_groups(rows.filter("maybe"), of_set.drop("node"), ["digest"], how="left")
    owner = F.when(F.col("doc_id").isNotNull(), F.col("owner")).alias("owner")
    alone = rows.filter("not maybe").withColumn("owner", F.lit(None).cast("struct<doc_id:bigint,mark:bigint>"))
    return some.select("doc_id", "mark", "n_shingles", owner).unionByName(alone.select("doc_id", "mark", "n_shingles", "owner"))


def near_groups(docs: DataFrame, how: Similar = Similar()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the least id that links reach), kept (its own is the least)."""
    component = F.coalesce("owner.doc_id", F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNotNull(), F.col("doc_id")))
    out = _rows(docs, how).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, how: Similar = Similar()) -> DataFrame:
    """``docs`` with one document of each group, that of the least id; all columns stay.

    Where an id has several texts, each is judged for itself; of rows with the same id and text, and of texts with the
    same id in one group, one stays.  Rows without an id or without words all stay."""
    mark, id_, gone, flag = (free_name(docs, c) for c in ("mark", "id", "gone", "flag"))
    rows = _rows(docs, how).filter("owner is not null and n_shingles > 0")
    rows = rows.groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "mark") != F.col("owner")).alias(gone))
    rows = settle(rows.filter(F.col(gone) | (F.col("n") > 1)).drop("n"), "gone")
    text_mark = F.xxhash64(F.col("text").cast("string"))
    marked = maybe_in(docs.withColumn(mark, text_mark), mark, rows.select(mark), flag)
    right = rows.select(id_, F.col(mark).alias(mark + "2"), gone)
    some = marked.filter(flag).join(right, (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(mark) == F.col(mark + "2")), "left")
    again = some.filter(~F.col(gone)).dropDuplicates([id_, mark])
    return marked.filter(~F.col(flag)).select(*docs.columns).unionByName(some.filter(F.col(gone).isNull()).select(*docs.columns)).unionByName(again.select(*docs.columns))
