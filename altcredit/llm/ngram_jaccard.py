"""Components of documents whose word n-gram sets have a Jaccard similarity of a threshold or more.

1. Fingerprints of all n-grams are exchanged between groups of documents (``recurring``). An
   n-gram of only one document can't be shared, so a document links to another only if at least
   the threshold's share of its n-grams recurs; others are done.
2. The candidates, once a distinct set, go to a block by their smallest recurring n-gram. Each block is a
   signature tree (``signature_tree``), a large block several, dealt by a hash. A dual traversal
   links its sets; one set a component and block then meets those of the block's other trees.
3. Whatever links are left are between different components. Two linked sets share a recurring
   n-gram of their prefixes (prefix filter: the rarest n-grams, by the groups that have them and
   then by hash, one more than may be missing), so a frequent n-gram opens no block where rarer ones do.
   n-grams whose sets are in several components are open. First one set a component and open n-gram
   is compared, which joins the parts of a family; then, for n-grams still open, all sets that have
   one. Open n-grams whose smallest set is the same make one block of all their sets, as those of a
   family mostly do; its trees are traversed as in step 2, a large block as pairs of parts. Every
   pair that shares an open n-gram meets, so no link that could join two components is missed.
4. Components of the linked components come from min-label propagation with pointer jumping.

That finds components without the links inside families. ``jaccard_links`` gives all links between
distinct sets: they lie within components, so the sets meet there, in trees that drop no pair for its
component; a large component as pairs of its parts. Families have as many links as pairs.

So no block holds a group's copies (equal sets are one), a family of near copies collapses in
step 2 without its pairs, and the answer names a component for each document.

Defined results: a text without words is linked with nothing and its component is its own id; a
null id never names a component unless all ids of the component are null; copies and repeated
rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altcredit.llm import kernels as K
from altcredit.llm import recurring as R
from altcredit.llm import signature_tree as T
from altcredit.llm.common import pieces_of, schema, small_batches, written

#: Bytes of tokens in one tree, and in one task.
TREE_BYTES = 8 << 20
TASK_BYTES = 8 << 20
#: Sets in one tree when all links are wanted, so that a task's links are bounded.
TREE_SETS = 2000
SETS = "size bigint, name bigint, block bigint, tokens binary"


def _sets(column, n: int):
    """Distinct n-gram hashes of each text, sorted; index of each text's first one; name of each set."""
    data, offsets = K.flat(column)
    starts, ends, first = K.word_spans(K.lower_ascii(data), offsets, K.byte_set(*K.WHITE))
    words = K.span_hashes(K.lower_ascii(data), starts, ends)
    counts = np.diff(first)
    owner, grams = [], []
    for size in range(1, n + 1):
        texts = np.flatnonzero(counts >= n if size == n else counts == size)
        number = counts[texts] - size + 1
        if len(texts):
            grams.append(K.window_hashes(words, size)[K.ranges(first[texts], number)])
            owner.append(np.repeat(texts, number))
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64), np.zeros(len(counts), np.uint64)
    owner, grams = np.concatenate(owner), np.concatenate(grams)
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1]))
    owner, grams = owner[new], grams[new]
    begin = np.searchsorted(owner, np.arange(len(counts) + 1))
    total = np.append(np.uint64(0), np.cumsum(K.mix(grams + np.uint64(1))))
    name = K.mix(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64))
    return grams, begin, name


def _candidates(grams, begin, recurs, percent):
    """Of each set: recurring n-grams, and whether they are enough for a link."""
    size = np.diff(begin)
    total = np.append(0, np.cumsum(recurs))
    shared = total[begin[1:]] - total[begin[:-1]]
    return shared, (size > 0) & (shared * 100 >= size * percent)


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, whole: bool = False
) -> DataFrame:
    """Rows (id, n_shingles, component, root[, row]), one for each document; ``row`` as in ``recurring.dealt``.

    ``root`` is a number that the documents of a component share; null for one without any link. With
    ``whole`` the rows hold the ``text`` too.
    """
    made, _, merged = _linked_sets(docs, key, text, n, percent, whole)
    least = _least_ids(made).join(merged, "name").groupBy("root").agg(F.min("least").alias("component"))
    names = merged.join(least, "root").select("name", "root", "component")
    keep = [c for c in ("text", "row") if c in made.columns]
    return made.join(names, "name", "left").select(
        "id", F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component"), "root", *keep
    )


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Rows (a, b, overlap, size_a, size_b), one for each two distinct sets that are linked.

    A set goes by the smallest id of its documents, ``a`` being smaller than ``b``, or null; documents of
    equal sets are linked too and have no row.
    """
    made, sets, merged = _linked_sets(docs, key, text, n, percent, False)
    several = merged.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
    members = merged.join(several, "root").select(F.col("root").alias("block"), "name").join(sets.drop("block"), "name")
    weight = F.octet_length("tokens") + F.lit(64)
    sizes = members.groupBy("block").agg(F.sum(weight).alias("bytes"), F.count("*").alias("members"))
    parts = F.ceil(F.greatest(F.col("bytes") * 2 / TREE_BYTES, F.col("members") * 2 / TREE_SETS)).cast("int")
    large = sizes.where((F.col("bytes") > TREE_BYTES) | (F.col("members") > TREE_SETS)).select("block", parts.alias("parts"))
    total = members.agg(F.sum(weight).alias("n")).first()["n"] or 0
    mine = F.coalesce(F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"), F.lit(0)).alias("mine")
    dealt = members.join(large, "block", "left").select("*", mine)
    dealt = dealt.select("*", F.explode(F.coalesce(_part_pairs(F.col("mine")), F.array(F.lit(0)))).alias("part"))
    units = _in_units(dealt, pieces_of(total, TASK_BYTES, 8))
    schema_out = "a bigint, b bigint, overlap bigint, size_a bigint, size_b bigint"
    found = units.applyInArrow(_link_kernel(percent), schema_out)
    ids = _least_ids(made)
    for side in ("a", "b"):
        found = found.join(ids.select(F.col("name").alias(side), F.col("least").alias(f"id_{side}")), side)
    swap = F.coalesce(F.col("id_a") > F.col("id_b"), F.lit(False))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return found.select(
        pick("id_a", "id_b").alias("a"), pick("id_b", "id_a").alias("b"), "overlap",
        pick("size_a", "size_b").alias("size_a"), pick("size_b", "size_a").alias("size_b"),
    )


def _least_ids(made: DataFrame) -> DataFrame:
    return made.where("name is not null").groupBy("name").agg(F.min("id").alias("least"))


def _linked_sets(docs: DataFrame, key: str, text: str, n: int, percent: int, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with the names of their sets, the distinct candidate sets, and rows (name, root)."""
    small_batches(docs.sparkSession)
    rows, groups = R.dealt(docs, key, text)
    buckets = R.buckets_of(groups)

    def grams_of(key, table):
        return R.send(key[0].as_py(), buckets, R.codes(_sets(table["text"], n)[0], buckets), narrow=True)

    fields = [f.name for f in rows.schema.fields if f.name in ("id", "row") or f.name == "text" and whole]

    def sets_of(key, table, found):
        grams, begin, name = _sets(table["text"], n)
        size = np.diff(begin)
        known, often = R.received_often(found)
        codes = R.codes(grams, buckets)
        recurs = K.member(known, codes)
        shared, enough = _candidates(grams, begin, recurs, percent)
        of = np.append(0, np.cumsum(shared))
        recurring = grams[recurs]
        # Rarest first in each set, equally rare ones by hash.
        rarity = often[np.searchsorted(known, codes[recurs])]
        owner = np.repeat(np.arange(len(size)), shared)
        smallest = np.zeros(len(size), np.uint64)
        smallest[shared > 0] = recurring[of[:-1][shared > 0]]
        recurring = recurring[np.lexsort((recurring, rarity, owner))]
        first = np.unique(np.where(enough, name, 0), return_index=True)[1]
        holds = np.zeros(len(size), bool)
        holds[first] = True
        holds &= enough
        tokens = [recurring[of[i] : of[i + 1]].tobytes() if h else None for i, h in enumerate(holds.tolist())]
        out = {
            "size": pa.array(size),
            "name": pa.array(name.view(np.int64), mask=~enough),
            "block": pa.array(smallest.view(np.int64), mask=~holds),
            "tokens": pa.array(tokens, pa.binary()),
        }
        return pa.table({name: table[name] for name in fields} | out)

    by = rows.groupBy("g")
    found = R.answers(by.applyInArrow(grams_of, R.SENT), narrow=True, often=True)
    made = written(by.cogroup(found.groupBy("g")).applyInArrow(sets_of, schema(rows, fields, SETS)), "sets")
    sets = written(made.where("tokens is not null").select("name", "size", "block", "tokens").dropDuplicates(["name"]), "distinct")
    linked = written(_linked_in_blocks(sets, percent), "trees")
    roots = _components(_links_between(sets, linked, linked.select("name", "root"), percent, one_each=True), linked.select("name", "root"))
    merged = _components(_links_between(sets, linked, roots, percent, one_each=False), roots)
    return made, sets, merged


def _tree_kernel(percent: int, prefix_out: bool):
    """Links the sets of each block in a table: rows (name, root[, prefix])."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"].to_numpy()
        part = table["part"].to_numpy()
        name = table["name"].to_numpy()
        root = table["root"].to_numpy()
        size = table["size"].to_numpy()
        rarest = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        tokens = [np.sort(t) for t in rarest]
        lead = np.array([[*t[:3], 0, 0, 0][:3] for t in tokens], np.uint64)
        order = np.lexsort((name, size, lead[:, 2], lead[:, 1], lead[:, 0], part, block))
        same = np.append(True, (np.diff(name[order]) != 0) | (np.diff(part[order]) != 0) | (np.diff(block[order]) != 0))
        order = order[same]
        block, part, name, root, size = block[order], part[order], name[order], root[order], size[order]
        tokens = [tokens[i] for i in order]
        begin = np.append(0, np.cumsum([len(t) for t in tokens]))
        group = np.cumsum(np.append(0, (np.diff(block) != 0) | (np.diff(part) != 0)))
        sets = T.Block(np.concatenate(tokens), begin, size)
        after = T.link(sets, group, root, percent)
        out = {"name": name, "root": root[after], "before": root}
        if prefix_out:
            missing = size - (size * percent + 99) // 100
            allowed = np.maximum(missing - (size - np.diff(begin)) + 1, 0)
            rarest = [rarest[i] for i in order]
            out["prefix"] = pa.array([t[:k].view(np.int64) for t, k in zip(rarest, allowed)], pa.list_(pa.int64()))
            # Tokens go on only where the block has more trees.
            more = (table["trees"].to_numpy()[order] > 1).tolist()
            out |= {"block": block, "size": size, "tokens": pa.array([t.tobytes() if m else None for t, m in zip(tokens, more)], pa.binary())}
        return pa.table(out)

    return run


def _link_kernel(percent: int):
    """All links of the blocks in a table; between two parts of a block, and within one where it is alone."""

    def run(table: pa.Table) -> pa.Table:
        block, part, mine, name, size = (table[c].to_numpy() for c in ("block", "part", "mine", "name", "size"))
        tokens = [np.sort(np.frombuffer(x, np.uint64)) for x in table["tokens"].to_pylist()]
        lead = np.array([[*t[:3], 0, 0, 0][:3] for t in tokens], np.uint64)
        order = np.lexsort((name, size, lead[:, 2], lead[:, 1], lead[:, 0], part, block))
        block, part, mine, name, size = (x[order] for x in (block, part, mine, name, size))
        tokens = [tokens[i] for i in order]
        begin = np.append(0, np.cumsum([len(t) for t in tokens]))
        group = np.cumsum(np.append(0, (np.diff(block) != 0) | (np.diff(part) != 0)))
        x, y, both = T.links(T.Block(np.concatenate(tokens), begin, size), group, percent)
        two = np.maximum.reduceat(mine, starts := np.flatnonzero(np.append(True, np.diff(group) > 0))) != np.minimum.reduceat(mine, starts)
        kept = ~two[group[x]] | (mine[x] != mine[y])
        x, y, both = x[kept], y[kept], both[kept]
        return pa.table({"a": name[x], "b": name[y], "overlap": both, "size_a": size[x], "size_b": size[y]})

    return run


def _in_units(dealt: DataFrame, tasks: int):
    """Groups for the kernels: each tree of a block with ``parts`` is one, all others share ``tasks``."""
    large = F.col("parts").isNotNull()
    return dealt.select(
        "*", F.when(large, F.col("block")).alias("own_block"), F.when(large, F.col("part")).alias("own_part"),
        F.when(~large, F.pmod(F.xxhash64("block", "part"), F.lit(tasks))).alias("task"),
    ).groupBy("own_block", "own_part", "task")


def _part_pairs(mine):
    """Numbers of the pairs of parts that a set of one part belongs to; null without parts."""
    return F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.least(mine, other) * F.col("parts") + F.greatest(mine, other),
    )


def _dealt_to_trees(sets: DataFrame, percent: int, prefix_out: bool, salt: int) -> DataFrame:
    """Blocks of more than a tree's bytes are dealt to several trees; many small trees share a task."""
    weight = F.octet_length("tokens") + F.lit(64)
    total = sets.agg(F.sum(weight).alias("n")).first()["n"] or 0
    large = sets.groupBy("block").agg(F.sum(weight).alias("bytes")).where(F.col("bytes") > TREE_BYTES)
    large = large.select("block", F.ceil(F.col("bytes") / TREE_BYTES).alias("trees"))
    trees = F.coalesce("trees", F.lit(1))
    dealt = sets.join(large, "block", "left").withColumn("trees", trees)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "name"), "trees"))
    task = F.pmod(F.xxhash64("block", "part"), F.lit(pieces_of(total, TASK_BYTES, 8))).cast("int")
    out = "name bigint, root bigint, before bigint"
    out += ", prefix array<bigint>, block bigint, size bigint, tokens binary" if prefix_out else ""
    return dealt.withColumn("task", task).groupBy("task").applyInArrow(_tree_kernel(percent, prefix_out), out)


def _linked_in_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Step 2: rows (name, root, prefix)."""
    first = written(_dealt_to_trees(sets.withColumn("root", F.col("name")), percent, True, 1), "first")
    again = first.where("name = root and tokens is not null").select("name", "size", "block", "tokens", "root")
    moved = _dealt_to_trees(again, percent, False, 2).where("root <> before").select(F.col("before").alias("root"), F.col("root").alias("to"))
    return first.join(moved, "root", "left").select("name", F.coalesce("to", "root").alias("root"), "prefix")


def _links_between(sets: DataFrame, linked: DataFrame, roots: DataFrame, percent: int, one_each: bool) -> DataFrame:
    """Step 3: links (a, b) between components; with ``one_each`` by one set a component and n-gram."""
    grams = linked.select("name", F.explode("prefix").alias("gram")).join(roots, "name")
    # A block is all sets that share an open n-gram whose smallest set is the same.
    ends = (F.min("root").alias("a"), F.max("root").alias("b"), F.min("name").alias("block"))
    several = grams.groupBy("gram").agg(*ends).where("a <> b").select("gram", "block")
    opened = grams.join(several, "gram").select("gram", "block", "name", "root")
    if one_each:
        opened = opened.groupBy("gram", "block", "root").agg(F.min("name").alias("name"))
    where = opened.select("block", "name", "root").distinct()
    return _pairs_of_parts(written(where, "blocks"), sets.select("name", "size", "tokens"), percent)


def _pairs_of_parts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Trees over each block; a block beyond a tree's bytes as all pairs of its parts."""
    if members.isEmpty():
        return members.select(F.col("name").alias("a"), F.col("name").alias("b"))
    weights = sets.select("name", (F.octet_length("tokens") + F.lit(64)).alias("weight"))
    sizes = written(members.join(weights, "name").groupBy("block").agg(F.sum("weight").alias("bytes")), "sizes")
    total = sizes.where(F.col("bytes") <= TREE_BYTES).agg(F.sum("bytes").alias("n")).first()["n"] or 0
    large = sizes.where(F.col("bytes") > TREE_BYTES)
    large = large.select("block", F.ceil(F.col("bytes") * 2 / TREE_BYTES).cast("int").alias("parts"))
    pairs = _part_pairs(F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    dealt = members.join(large, "block", "left").select("*", F.explode(F.coalesce(pairs, F.array(F.lit(0)))).alias("part"))
    filled = _in_units(dealt.join(sets, "name"), pieces_of(total, TASK_BYTES, 8))
    out = filled.applyInArrow(_tree_kernel(percent, False), "name bigint, root bigint, before bigint")
    return out.where("root <> before").select(F.col("root").alias("a"), F.col("before").alias("b")).distinct()


def _components(links: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (name, root) once the links between roots are followed."""
    links = written(links, "links")
    if links.isEmpty():
        return names
    both = written(links.union(links.select("b", "a")).distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        heard = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = label.join(heard, "node").select("node", F.least("label", "heard").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if after.join(label, ["node", "label"], "left_anti").isEmpty():
            break
        label = after
    final = label.select(F.col("node").alias("root"), F.col("label").alias("to"))
    return written(names.join(final, "root", "left").select("name", F.coalesce("to", "root").alias("root")), "roots")
