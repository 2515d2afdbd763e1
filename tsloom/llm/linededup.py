"""Fuzzy line deduplication by MinHash, in DataFrame functions alone.

A line's normal form is lower-cased, with runs of blanks as one space and none at the ends. Its shingles are the strings of
SHINGLE characters that begin at each of its characters (a shorter line is one shingle); its set holds their 64-bit hashes. The
sorted hashes are the shingles in random order, so the ROWS smallest from any point on are the minima of a permutation:
two lines agree in them with the probability of similarity ** ROWS. Such runs begin at each of BANDS points, evenly dealt over the
hash's range (past the largest hash comes the smallest); a hash of each run lists the line (one-permutation hashing). Few
shingles take shorter runs: CLASSES says which; where two classes overlap, a line is listed in both, so that any
two lines that can be similar are in one class together. A line of many words is listed by the set of its words of WORD bytes and more
instead, which is as similar as the shingles are where changes are spread (an altered character costs one of the words, of some
six characters, or five shingles), more so where words change, and takes less time. Of other long lines, only those shingles are hashed for the lists whose first
two characters are of two fixed classes, about one of six: whether a shingle is taken rests on the shingle alone, so
the taken ones of two lines agree as the sets do. A line with fewer than DENSE of them is listed by its whole set, one with at least
SPARSE by the taken ones, one between by both; so is one whose words are neither many nor few. Lines that meet in a list, and whose sets are not too
different in size, are compared by the exact Jaccard similarity of their sets; links of at least `percent` are joined into
components by distributed union-find, and of each component the first line (by document id, then place in the document) stays. A
pair at the threshold of 0.8 meets in some list of whole sets with a probability of 0.97 (60 shingles) to 0.985 (200 and more), one at 0.85
with 0.999, as simulated.

Nulls and odd input: a null text has no lines and stays null; blank lines are never dropped. Null ids come before others.
Rows that repeat id and text are treated alike: their lines stay or go together. An empty table gives an empty result.
Input columns are kept; n_lines and n_dropped replace input columns of these names. Two of a million distinct
lines share a hash with a probability of 3e-8, and so do two of a million shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.clusters import link_lists
from tsloom.llm.common import Tables, fresh

SHINGLE, BANDS = 5, 16
#: Least and most shingles of a class, and the length of its runs. The least of each is at most 0.8 times (the most of the one before, and one).
CLASSES = [(1, 20, 3), (17, 100, 5), (81, None, 7)]
PERCENT = 80
#: Taken shingles (see above) from which a line is listed by them, and from which it is not listed by its whole set.
SPARSE, DENSE = 30, 45
#: As BANDS and CLASSES, for the taken ones. More bands, as their similarity strays from that of the sets.
TAKEN_BANDS = 24
TAKEN_CLASSES = [(1, None, 7)]
#: Characters from which on shingles are taken from a line; a shorter one is listed by its whole set.
TAKEN_LENGTH = 150
#: Bytes of the words that list a line, so that the commonest do not.
WORD = 4
#: Distinct such words, and characters for each at most, with which they list a line, and with which nothing else does.
WORDY, ALL_WORDY = (12, 40), (16, 30)
WORD_BANDS = 12
WORD_CLASSES = [(1, 100, 4), (80, None, 5)]
#: Shingles whose first character's code is odd and whose second's has the bit of 2, both up to 0xFF. Matches overlap.
_TAKEN = r"(?s)(?=([{}][{}].{{{}}}))".format(*["".join(rf"\x{c:02x}" for c in range(0x21, 0x100) if c & bit) for bit in (1, 2)], SHINGLE - 2)
_BLANK = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
_BYTES = 4  # of a character in UTF-32


def normal(low: Column) -> Column:
    """The normal form of a lower-cased line."""
    odd = F.contains(low, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(low, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(low, _BLANK + "+", " ")).otherwise(low))


def shingles(norm: Column) -> Column:
    """The array of the hashes of a normal line's shingles, in order."""
    width = SHINGLE * _BYTES

    def each(wide: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - (width - 1), F.lit(1)), F.lit(_BYTES))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(wide, i, F.lit(width))))

    # as a lambda's variable, the encoded line is read once, not once for each shingle
    return F.transform(F.array(F.encode(norm, "utf-32")), each)[0]


def shingle_set(norm: Column) -> Column:
    """The array of the hashes of a normal line's distinct shingles."""
    return F.array_distinct(shingles(norm))


def taken_set(norm: Column) -> Column:
    """The array of the hashes of those of a normal line's distinct shingles that stand for all of a long one."""
    return F.array_distinct(F.transform(F.regexp_extract_all(norm, F.lit(_TAKEN), 1), lambda x: F.xxhash64(x)))


def word_set(norm: Column) -> Column:
    """The array of the hashes of a normal line's distinct words of WORD bytes and more."""
    return F.array_distinct(F.transform(F.filter(F.split(norm, " "), lambda x: F.octet_length(x) >= WORD), lambda x: F.xxhash64(x)))


def signatures(lines: DataFrame) -> DataFrame:
    """list, node of lines (node, norm); a list and node may repeat."""
    kinds = [(BANDS, CLASSES), (TAKEN_BANDS, TAKEN_CLASSES), (WORD_BANDS, WORD_CLASSES)]
    longest = max(rows for _, classes in kinds for _, _, rows in classes)
    length = F.char_length("norm")

    def wordy(least: int, each: int) -> Column:
        return (F.size("words") >= least) & (length <= each * F.size("words"))

    words = lines.select("node", "norm", word_set(F.col("norm")).alias("words"))
    none = F.array().cast("array<bigint>")
    taken = F.when(~wordy(*ALL_WORDY) & (length >= TAKEN_LENGTH), taken_set(F.col("norm"))).otherwise(none)
    taken = words.select("node", "norm", "words", taken.alias("taken"))
    # the outer forms keep the optimizer from adding a filter that makes each array twice
    whole = F.when(~wordy(*ALL_WORDY) & (F.size("taken") < DENSE), shingle_set(F.col("norm")))
    sets = F.array(whole, F.when(F.size("taken") >= SPARSE, F.col("taken")), F.when(wordy(*WORDY), F.col("words")))
    sets = taken.select("node", F.posexplode_outer(sets).alias("kind", "s")).where("s IS NOT NULL").select("node", "kind", F.sort_array("s").alias("s"))
    each = sets.select("node", "kind", "s", F.concat("s", F.slice("s", 1, longest - 1)).alias("round")).select("node", "kind", "s", "round", F.posexplode_outer("s").alias("i", "h"))
    bands = F.get(F.array(*[F.lit(b) for b, _ in kinds]), F.col("kind"))
    part = lambda h: F.shiftright(F.shiftright(h, 40) * bands, 24)  # noqa: E731  of the hash's range
    first = each.where((F.col("i") == 0) | (part(F.col("h")) != part(F.get("s", F.col("i") - 1))))
    n = F.size("s")

    def key(kind: int, least: int, most: int | None, rows: int) -> Column:
        held = (F.col("kind") == kind) & (n >= least) & (F.lit(True) if most is None else n <= most)
        # a run no longer than the set may begin anywhere; shorter sets are taken as a whole
        return F.when(held, F.xxhash64(F.lit(kind), F.lit(rows), F.slice("round", F.col("i") + 1, F.least(F.lit(rows), n))))

    keys = F.array(*[key(kind, *c) for kind, (_, classes) in enumerate(kinds) for c in classes])
    return first.select("node", F.explode_outer(keys).alias("list")).where("list IS NOT NULL").select("list", "node")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, pos, norm, node of each line that is not blank."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.split(F.lower(text_col), "\n", -1)).alias("pos", "line"))
    # blank lines are told by the line itself: a filter on the normal form would make it twice
    rows = rows.where(F.ltrim("line", F.lit(_BLANKS)) != "")
    return rows.select("id", "text_hash", "pos", normal(F.col("line")).alias("norm")).withColumn("node", F.xxhash64("norm"))


def line_components(lines: DataFrame, tables: Tables, percent: int = PERCENT) -> DataFrame:
    """node, root of the distinct lines (node, norm) that are near some other one; a table of tables."""
    # dealt out once by list; the aggregate and the join below need the same columns, so both read this exchange
    listed = signatures(lines).repartition("list")
    lists = listed.groupBy("list").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    # the shared lists are few: hashed, they spare the sorting of all. Most have two lines: such a pair is known by its lines, whatever
    # number of lists it is in, and needs no hubs
    shared = listed.join(lists.hint("shuffle_hash"), "list").where("n > 2 OR node = lo").select("list", "node", F.when(F.col("n") == 2, F.col("hi")).alias("other")).distinct()
    shared = tables.store(shared, "shared")
    members = shared.where("other IS NULL").select("list", "node")
    couples = shared.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    # lines, not their sets, go to the pairs: a set is many times as large
    # hashed, the wanted ones spare the sorting of all lines
    wanted = shared.select(F.explode(F.array("node", "other")).alias("node"), F.col("other").isNull().alias("many")).where("node IS NOT NULL").groupBy("node").agg(F.max("many").alias("many"))
    norms = lines.select("node", "norm").join(wanted.hint("shuffle_hash"), "node")
    # only lists of more than two lines need their sizes
    norms = tables.store(norms.select("node", "norm", F.when(F.col("many"), F.size(shingle_set(F.col("norm")))).alias("size")), "line-norms", None, True)
    sized = tables.store(members.join(norms.select("node", "size"), "node").select("list", "node", "size"), "members")

    def verify(pairs: DataFrame) -> DataFrame:
        x = norms.select(F.col("node").alias("a"), F.col("norm").alias("x"))
        y = norms.select(F.col("node").alias("b"), F.col("norm").alias("y"))
        # as an exploded value, both sets are made once: a filter makes them anew wherever it names them
        sets = F.explode_outer(F.array(F.struct(shingle_set(F.col("x")).alias("x"), shingle_set(F.col("y")).alias("y")))).alias("s")
        each = pairs.join(x, "a").join(y, "b").select("a", "b", sets)
        return each.where((100 + percent) * F.size(F.array_intersect("s.x", "s.y")) >= percent * (F.size("s.x") + F.size("s.y"))).select("a", "b")

    def possible(x, y):
        return 100 * F.least(f"{x}.size", f"{y}.size") >= percent * F.greatest(f"{x}.size", f"{y}.size")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return norms.join(nodes, "node", "left_semi").select("node", shingle_set(F.col("norm")).alias("values"))

    def most_apart(x, y):
        return (F.col(f"{x}.size") + F.col(f"{y}.size")) * (100 - percent) / (100 + percent)

    roots = link_lists(sized, verify, possible, sets_of, most_apart, tables, couples)
    tables.drop(norms, shared)
    return roots


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with their text less the dropped lines, n_lines (not blank) and n_dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    tables = Tables(docs.sparkSession)
    places = tables.store(occurrences(docs, id_col, text_col), "line-places", None, True)
    firsts = tables.store(places.groupBy("node").agg(F.min(F.struct("id", "pos", "text_hash")).alias("first"), F.count("*").alias("n"), F.first("norm").alias("norm")), "first-places", None, True)
    # the lines' text is in firsts from here on
    slim = tables.store(places.drop("norm"), "line-places")
    tables.drop(places)
    roots = line_components(firsts, tables, percent)
    judged = firsts.join(roots, "node", "left").where("n > 1 OR root IS NOT NULL").select("node", F.coalesce("root", "node").alias("root"), "first")
    judged = tables.store(judged, "judged-lines")
    stay = judged.groupBy("root").agg(F.min("first").alias("stay"))
    judged = judged.join(stay, "root").select("node", "stay").hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("pos") == F.col("stay.pos")) & (F.col("text_hash") == F.col("stay.text_hash"))
    gone = slim.join(judged, "node").where(~same)
    gone = gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    t_id, t_hash, t_gone = fresh(docs, "gone_id", "gone_hash", "gone")
    gone = tables.keep(tables.store(gone.select(F.col("id").alias(t_id), F.col("text_hash").alias(t_hash), F.col("gone").alias(t_gone)), "dropped-lines"))
    tables.drop()
    out = docs.join(gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(gone[t_id]) & (F.xxhash64(docs[text_col]) == gone[t_hash]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(t_gone), i)), "\n")
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long"), "n_dropped": F.coalesce(F.size(t_gone), F.lit(0)).cast("long"), text_col: F.when(F.col(t_gone).isNull(), F.col(text_col)).otherwise(left)})
    return out.drop(t_id, t_hash, t_gone)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
