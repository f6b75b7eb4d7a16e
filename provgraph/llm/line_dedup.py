"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines are near when they are within min(TAU, n div EACH) edits, n being the letters of the shorter one:
an edit for each EACH letters, TAU at most, for lines of every length; unrelated short lines, which few edits
would turn into each other, stay apart, and those under EACH letters are near their copies only. Of lines within t edits, if
the shorter one is cut into t + 1 segments, one segment stands unchanged in the other, at a place that the lengths and the edits before and after it bound. Each distinct line gives
its own segments and, for every length it may match, the few substrings at those places; equal keys
(length, segment, content) make candidates. Keys that one line alone has are dropped by a count before
anything is joined. A candidate pair is compared first by the parity of its letters, of which TAU edits
change at most 2 * TAU bits, then by that of its pairs of letters; keys with more than HOT lines are split by the parity's parts, one of
which must agree. The edit distance is then verified by a band of 2 * TAU + 1 bits for each number of
errors, advanced letter by letter.

A line is known by a 128-bit digest; a copy is not compared again. Classes are connected components; a class keeps its first line in the order
of doc_id (nulls last) and line number.

Defined results: a null text has no lines, an empty text one empty line; repeated rows are copies;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, own_columns, scope, sized, table, written

#: Edits of near lines at most, letters for each.
TAU, EACH = 2, 8
#: Rows of a key up to which its pairs are formed directly.
HOT = 64
OWN, PROBE = 1, 2


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h1, h2)"""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def allowed(n: Column | str, tau: int = TAU) -> Column:
    """The edits that make lines near whose shorter one has n letters."""
    return F.least(F.lit(tau), F.floor((F.col(n) if isinstance(n, str) else n) / EACH)).cast("int")


def places(tau: int) -> list[tuple[int, int, int, int]]:
    """(shorter, i, shift, kind): where in a line the i-th segment of one that is shorter by so many letters may stand.

    Edits before a segment shift it by at most i, those behind it by at most tau - i against the difference.
    """
    found = []
    for shorter in range(tau + 1):
        for i in range(tau + 1):
            for shift in range(max(-i, shorter - (tau - i)), min(i, shorter + (tau - i)) + 1):
                found.append((shorter, i, shift, OWN | PROBE if shorter == shift == 0 else PROBE))
    return found


def keyed_lines(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """(key, kind, h1, h2): each line's own segments, and the substrings that may be segments of an equal or shorter line."""
    names = ("t", "shorter", "i", "shift", "kind")
    marks = F.array(*(F.struct(*(F.lit(x).alias(name) for x, name in zip((t, *p), names, strict=True))) for t in range(1, tau + 1) for p in places(t)))
    rows = lines.withColumn("n", F.char_length("line")).where(F.col("n") >= EACH).select("h1", "h2", "line", "n", F.explode(marks).alias("q"))
    # the shorter line's length says how many edits, and so how many segments: of m div parts letters, the last ones of one more
    rows = rows.select("h1", "h2", "line", "q.i", "q.shift", "q.kind", (F.col("q.t") + 1).alias("parts"), (F.col("n") - F.col("q.shorter")).alias("m")).where(allowed("m", tau) + 1 == F.col("parts"))
    rows = rows.select("*", F.expr("m div parts").cast("int").alias("base"), (F.col("parts") - F.col("m") % F.col("parts")).cast("int").alias("longer_from"))
    start = F.col("i") * F.col("base") + F.greatest(F.lit(0), F.col("i") - F.col("longer_from")) + F.col("shift")
    rows = rows.select("h1", "h2", "line", "kind", "m", "i", start.alias("start"), (F.col("base") + (F.col("i") >= F.col("longer_from")).cast("int")).alias("size")).where("start >= 0")
    return rows.select(F.xxhash64("m", "i", F.substring("line", F.col("start") + 1, F.col("size"))).alias("key"), "kind", "h1", "h2")


def letters(line: str) -> Column:
    return F.regexp_extract_all(F.col(line), F.lit("(?s)."), F.lit(0))


def parity(line: str = "line") -> Column:
    """A bit for each of 60 classes of letters: whether the line has an odd number of them."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(60)).cast("int"))
    return F.aggregate(letters(line), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def pair_parity(line: str = "line") -> Column:
    """As parity, of the line's pairs of neighbouring letters, of which an edit changes at most four."""
    of = letters(line)
    pairs = F.zip_with(F.slice(of, 1, F.greatest(F.lit(0), F.size(of) - 1)), F.slice(of, 2, F.size(of)), lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(60)).cast("int"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def part(parity_: Column, j: int, tau: int = TAU) -> Column:
    """The j-th of 2 * tau + 1 parts of a parity."""
    width = 60 // (2 * tau + 1)
    return F.shiftright(parity_, j * width).bitwiseAND(F.lit((1 << width) - 1))


def edits(a: str, b: str, tau: int = TAU) -> Column:
    """Edit distance of two columns of letter arrays, tau + 1 if it is larger.

    Bit d + tau of word k: with k errors, the letters of b read so far may match those of a up to d
    more. A letter keeps a bit where it equals a's next one; an error moves bits between words, in
    place, one down (a letter of b too many) or one up (one too few).
    """
    p, t = F.col(a), F.col(b)
    band = (1 << (2 * tau + 1)) - 1
    names = [f"r{k}" for k in range(tau + 1)]
    begin = F.struct(*(F.lit(((1 << (k + 1)) - 1) << tau).cast("long").alias(names[k]) for k in range(tau + 1)))

    def step(state: Column, i: Column) -> Column:
        here = F.get(t, i)
        same = reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.coalesce(F.get(p, i + (d - tau)) == here, F.lit(False)), F.lit(1 << d)).otherwise(F.lit(0)).cast("long") for d in range(2 * tau + 1)))
        words = [state[names[0]].bitwiseAND(same)]
        for k in range(1, tau + 1):
            was = state[names[k - 1]]
            word = state[names[k]].bitwiseAND(same).bitwiseOR(was).bitwiseOR(F.shiftright(was, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
            words.append(word.bitwiseAND(F.lit(band)))
        return F.struct(*(w.alias(x) for w, x in zip(words, names, strict=True)))

    steps = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    place = F.size(p) - F.size(t)
    hit = lambda w: F.shiftright(w, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place + tau).cast("int"))) > 0
    result = lambda s: F.coalesce(*(F.when(hit(s[names[k]]), F.lit(k)) for k in range(tau + 1)), F.lit(tau + 1))
    return F.when(F.abs(place) > tau, F.lit(tau + 1)).otherwise(F.aggregate(steps, begin, step, result))


def candidates(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """(key, kind, h1, h2): keys that several lines have, with those lines."""
    keyed = keyed_lines(lines, tau)
    seen = keyed.groupBy("key").agg(F.bit_or("kind").alias("kinds"), F.min("h1").alias("x"), F.max("h1").alias("y"))
    shared = written(seen.where((F.col("kinds") == (OWN | PROBE)) & (F.col("x") != F.col("y"))).select("key"), "keys")
    return written(keyed.join(sized(shared), "key").groupBy("key", "h1", "h2").agg(F.bit_or("kind").alias("kind")), "hits")


def near_links(lines: DataFrame, tau: int = TAU) -> tuple[DataFrame, DataFrame]:
    """nodes (node, h1, h2) and links (a, b) with a < b: distinct lines near each other."""
    hits = candidates(lines, tau)
    ids = written(hits.select("h1", "h2").distinct(), "ids")
    texts = lines.select("h1", "h2", "line").join(sized(ids), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    nodes = written(texts.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "line", F.char_length("line").alias("n"), parity().alias("parity"), pair_parity().alias("pairs")), "nodes")

    rows = hits.join(nodes.select("h1", "h2", "node", "n", "parity"), ["h1", "h2"]).drop("h1", "h2")
    size = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HOT), "hot")
    rows = rows.join(size, "key", "left")
    parts = 2 * tau + 1
    split = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.struct(j.alias("j"), F.element_at(F.array(*(part(F.col("parity"), i, tau) for i in range(parts))), j + 1).alias("part")))
    whole = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("part")))
    rows = written(rows.withColumn("s", F.explode(F.when(F.col("size").isNotNull(), split).otherwise(whole))).select("key", "s.*", "kind", "node", "n", "parity"), "rows")
    own = rows.where(F.col("kind").bitwiseAND(F.lit(OWN)) > 0).select("key", "j", "part", F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    probe = rows.where(F.col("kind").bitwiseAND(F.lit(PROBE)) > 0).select("key", "j", "part", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    # a pair is formed in the first part that agrees
    earlier = reduce(lambda x, y: x | y, ((F.col("j") > i) & (part(F.col("pa"), i, tau) == part(F.col("pb"), i, tau)) for i in range(parts)))
    near = (F.col("na") <= F.col("nb")) & (F.col("nb") - F.col("na") <= allowed("na", tau)) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = own.join(probe, ["key", "j", "part"]).where(near & ~earlier & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 2 * allowed("na", tau)))
    pairs = pairs.select("a", "b").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("pairs").alias(f"p{x}"), F.col("line").alias(f"l{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 4 * tau)
    pairs = written(pairs.select("a", "b", letters("la").alias("la"), letters("lb").alias("lb")), "pairs")
    links = pairs.where(edits("la", "lb", tau) <= allowed(F.least(F.size("la"), F.size("lb")), tau)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return nodes.select("node", "h1", "h2"), written(links, "links")


def line_classes(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row for each distinct line: h1, h2, line_md5, its first place, its copies, its class' first place and size, its links, kept."""
    lines = lines_of(docs)
    with scope(docs.sparkSession):
        nodes, links = near_links(lines, tau)
        roots = components(docs.sparkSession, links)
        counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        linked = written(nodes.join(roots, "node").join(counts, "node").select("h1", "h2", "root", "n_links"), "linked", result=True)

    place = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").cast("long").alias("doc_id"), "line_no")
    distinct = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.max(F.md5("line")).alias("line_md5"))
    rows = written(distinct.join(linked, ["h1", "h2"], "left"), "distinct")
    classes = rows.where("root is not null").groupBy("root").agg(F.min("first").alias("f"), F.count(F.lit(1)).alias("class_size"))
    out = rows.join(sized(written(classes, "classes")), "root", "left")
    best = F.coalesce("f", "first")
    return out.select("h1", "h2", "line_md5", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "copies",
                      best["doc_id"].alias("class_doc_id"), best["line_no"].alias("class_line_no"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("first").eqNullSafe(best).alias("kept"))


def drop_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """docs with only the lines that are the first of their class; empty lines stay everywhere."""
    uid, kept_text = fresh("uid", docs), fresh("kept_text", docs)
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    kept = line_classes(rows, tau).where("kept").select("h1", "h2", F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    lines = lines_of(rows.withColumn("doc_id", F.struct("doc_id", uid))).withColumn(uid, F.col(f"doc_id.{uid}")).withColumn("doc_id", F.col("doc_id.doc_id"))
    own = lines.join(kept, ["h1", "h2"], "left").where((F.col("line") == "") | (F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l"))))
    texts = own.groupBy(uid).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias(kept_text))
    out = rows.join(texts, uid, "left")
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce(kept_text, F.lit("")))).select(*own_columns(docs))


def op10_edit_join_lines(spark, sf_dir):
    return line_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("h1", "h2")
