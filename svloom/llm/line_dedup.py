"""Line dedup: an exact set-similarity join of lines in DataFrame functions alone.

A line is the set of its words (cut at white space). Words are ordered by rarity: SKETCH counters
hold how often the words of their bucket occur in the corpus, and a word's key is its counter's level
before its hash, so all lines share one order whatever the counters merge. Equal lines, told by two
64-bit digests of their bytes, become one, the first by (doc_id, position). Of n keys the n - ceil(t n) + 1 rarest form the prefix:
two lines with a Jaccard similarity of t share a key there. Lines meet under a prefix key and a class of lengths: each
in its own, and in the next one with those keys that a line of that length could still need. Lines that meet, whose lengths
allow t, whose places leave enough keys behind, and whose parity sketches differ in no more bits than
the sets may, are candidates; their Jaccard similarity is verified on the whole sets of 64-bit
word hashes. A line goes if an earlier line is similar: earlier by doc_id, then position, judged on the input.

Groups of similar lines cost rows in proportion: under those of its LEADS rarest keys that more than HOT lines
have, each line is tried against the first line and NEAR others; only lines that this doesn't settle are joined to all others.

Lines without a word stay. A null text stays null. Rows that repeat a doc_id are versions of one
document: lines at the same place are never earlier than one another. Null doc_ids come first.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import P, forget, saved

#: Counters of the rarity sketch: a fixed size, whatever the vocabulary.
SKETCH = 1 << 17
#: Jaccard similarity, in hundredths.
SIMILARITY = 80
#: Rarest keys of a line, and the neighbours under each of them that are tried before all others.
LEADS, NEAR = 6, 5
#: Lines under one key that are joined to one another without such a trial.
HOT = 200
#: Lines of fewer words have a parity sketch of 64 bits, others one of 128.
FEW = 64
#: Rows of 64 bytes at most that may be broadcast, so 25 MB; beyond, the join is by shuffle.
BROADCAST_ROWS = 400_000
#: Postings a shuffle partition, of some 100 bytes each, that are joined through a hash table; more are sorted.
HASHED_ROWS = 1_500_000
#: The greatest level, and the least key of a word that occurs more than HOT times.
_TOP = 126
_HOT_KEY = min(_TOP, math.floor(6 * math.log2(HOT + 1)) + 1) << 56
#: Stands for a null doc_id.
_FIRST = -(1 << 63)


#: White space besides the line end and the space; few texts have any.
_RARE = "\t\x0b\x0c\r"


def _words(text: Column, ends: bool = True) -> Column:
    """Words as the other operators cut them, with empty ones between neighbouring spaces; an empty text has one empty word.

    ends: whether the text may have line ends.
    """
    odd = F.lit(False)
    for c in _RARE:
        odd = odd | F.contains(text, F.lit(c))
    usual = F.replace(text, F.lit("\n"), F.lit(" ")) if ends else text
    return F.split(F.when(odd, F.translate(text, "\n" + _RARE, " " * 5)).otherwise(usual), " ")


def _hashes(line: Column) -> Column:
    return F.transform(F.array_remove(_words(line, ends=False), ""), lambda w: F.xxhash64(w))


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_FIRST))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos and line for each line of each document; a null doc_id as the least integer."""
    parts = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    return docs.select(_id(docs).alias("doc_id"), F.posexplode(parts).alias("pos", "line"))


def _bucket(h: Column) -> Column:
    """A counter's index: the hash's top bits."""
    return F.shiftrightunsigned(h, 65 - SKETCH.bit_length())


def rarity(docs: DataFrame) -> DataFrame:
    """One row: levels, a small integer in the top byte for each counter, greater for more occurrences."""
    spark = docs.sparkSession
    words = docs.select(F.explode(_words(F.col("text").cast("string"))).alias("w")).where("w <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).cast("int").alias("id")).agg(F.count("*").alias("n"))
    level = F.shiftleft(F.least(F.lit(_TOP), F.floor(6 * F.log2(F.coalesce("n", F.lit(0)) + 1)) + 1).cast("long"), 56)
    every = spark.range(SKETCH).select(F.col("id").cast("int").alias("id")).join(counts, "id", "left").select("id", level.alias("level"))
    group = every.groupBy(F.shiftright("id", 9).alias("g")).agg(F.sort_array(F.collect_list(F.struct("id", "level"))).alias("s"))
    whole = group.agg(F.sort_array(F.collect_list(F.struct("g", "s"))).alias("s"))
    return whole.select(F.flatten(F.transform("s", lambda x: x["s"]["level"])).alias("levels"))


def line_sets(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """rows with keys, the sorted distinct word keys of column line, and n, their number; lines without a word are left out."""

    def key(h: Column) -> Column:
        # Without nulls, arrays are sorted as plain longs; a line's functions run for each word, so they are few.
        return F.coalesce(F.get(f"{P}levels", _bucket(h)).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))

    # A filter on n would have the keys made twice.
    worded = rows.where(F.btrim("line", F.lit(" " + _RARE)) != "")
    found = worded.withColumn(f"{P}levels", levels.scalar()).withColumn("keys", F.sort_array(F.array_distinct(F.transform(_hashes(F.col("line")), key))))
    return found.drop(f"{P}levels").withColumn("n", F.size("keys"))


def _drawn(n: str) -> str:
    """How many of a line's rarest keys its parity sketch holds: all of FEW, of more a half."""
    return f"least({n}, greatest({FEW}, {n} div 2))"


def _parity(half: int) -> Column:
    """64 of 128 bits, each the parity of the rarest keys that fall on it; lines of few words have all on the first 64, and no others."""
    drawn = F.slice("keys", F.lit(1), F.expr(f"cast({_drawn('n')} as int)"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    fold = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(bit(k)))
    own = fold(F.filter(drawn, lambda k: k.bitwiseAND(F.lit(64)) == 64 * half))
    few = F.col("n") < FEW
    return F.when(~few, own) if half else F.when(few, fold(F.col("keys"))).otherwise(own)


def _differing(p: str, q: str) -> str:
    """Bits in which two sketches differ, as far as both have them."""
    fold = lambda x: f"({x}.b0 ^ coalesce({x}.b1, 0))"
    return f"if({p}.b1 is null or {q}.b1 is null, bit_count({fold(p)} ^ {fold(q)}), bit_count({p}.b0 ^ {q}.b0) + bit_count({p}.b1 ^ {q}.b1))"


def _needed(a: str, b: str) -> str:
    """Shared keys that the similarity asks of sets of two sizes."""
    return f"(({SIMILARITY} * ({a} + {b}) + {99 + SIMILARITY}) div {100 + SIMILARITY})"


def _candidate(later: str, earlier: str) -> str:
    """Order, length, positional and sketch filters for two postings of one key.

    The shorter line shares 2t / (1 + t) of its keys at least, so a shared key lies in a shorter prefix of its own.
    Of n keys those not shared number n - need at most, so the d rarest hold the first d - n + need shared ones at least;
    what both sketches hold of these doesn't show where the sketches differ.
    """
    p, q = later, earlier
    n, m = f"{p}.n", f"{q}.n"
    need = _needed(n, m)
    return (
        f"({q}.doc_id < {p}.doc_id or {q}.doc_id = {p}.doc_id and {q}.pos < {p}.pos)"
        f" and 100 * least({n}, {m}) >= {SIMILARITY} * greatest({n}, {m})"
        f" and least({n} - {p}.i, {m} - {q}.i) >= {need}"
        f" and if({n} <= {m}, {p}.i <= {n} - {_needed(n, n)}, {q}.i <= {m} - {_needed(m, m)})"
        f" and {_differing(p, q)} <= {_drawn(n)} + {_drawn(m)} - 2 * ({need} + least({_drawn(n)} - {n}, {_drawn(m)} - {m}))"
    )


def _class(n: str) -> str:
    """A class of lengths; lines whose lengths allow the similarity are of one class or of neighbours."""
    return f"cast(floor(ln({n}) / ln(100 / {SIMILARITY})) as int)"


def postings(lines: DataFrame) -> DataFrame:
    """lines by meet, a hash of a prefix key and a class of lengths, with i, the key's place, and whether the line is a guest there.

    A guest is the shorter one of a pair: where all others have m keys or more it needs no keys beyond n - _needed(n, m).
    """
    least = f"greatest(n, cast(floor(pow(100 / {SIMILARITY}, g) * 0.999999) as int))"
    own = lines.withColumn("g", F.expr(_class("n"))).withColumn("guest", F.lit(False)).withColumn("own", F.col("prefix"))
    visits = lines.withColumn("g", F.explode(F.expr(f"filter(array({_class('n')} + 1), g -> g <= {_class(f'n * 100 / {SIMILARITY}')})"))).withColumn("guest", F.lit(True))
    visits = visits.withColumn("own", F.expr(f"slice(prefix, 1, greatest(0, cast(n - {_needed('n', least)} + 1 as int)))"))
    at = [c for c in lines.columns if c != "prefix"]
    both = own.unionByName(visits).select(*at, "g", "guest", F.posexplode("own").alias("i", "key"))
    return both.select(*at, "guest", "i", F.xxhash64("key", "g").alias("meet"))


_PAIR = ("p.doc_id", "p.pos", "q.doc_id as doc_id2", "q.pos as pos2")
#: Columns of packed postings, and what they hold.
_PACKED = {"at": "shiftleft(cast(pos as bigint), 32) | n", "how": "cast(i as bigint) * 4 + if(guest, 2, 0) + if(open, 1, 0)"}
_HELD = {"pos": "cast(shiftright({}.at, 32) as int)", "n": "cast({}.at & 2147483647 as int)", "i": "cast(shiftright({}.how, 2) as int)", "guest": "({}.how & 2 <> 0)", "open": "({}.how & 1 <> 0)"}


def _unpacked(sql: str) -> str:
    """An expression of postings p and q over packed ones, whose rows are a third shorter."""
    return re.sub(rf"\b([pq])\.({'|'.join(_HELD)})\b", lambda found: _HELD[found[2]].format(found[1]), sql)


def _small(df: DataFrame, weight: str = "1") -> DataFrame:
    """df, to be broadcast if its rows weigh little."""
    few = df.limit(BROADCAST_ROWS + 1).agg(F.coalesce(F.sum(F.expr(weight)), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if few <= BROADCAST_ROWS else df


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id and pos of the later lines of those pairs that are similar."""
    pairs = saved(pairs, "line-pairs")
    wanted = saved(pairs.select("doc_id", "pos").unionByName(pairs.select(F.col("doc_id2").alias("doc_id"), F.col("pos2").alias("pos"))).distinct(), "wanted-lines")
    ids = _small(wanted.select(F.col("doc_id").alias(f"{P}id")).distinct())
    near = docs.select("doc_id", "text")
    near = near.join(ids, _id(near) == F.col(f"{P}id"), "left_semi")
    held = lines(near).join(_small(wanted), ["doc_id", "pos"], "left_semi")
    held = saved(held.select("doc_id", "pos", F.array_distinct(_hashes(F.col("line"))).alias("w")), "candidate-lines")
    if held.count() > wanted.count():
        held = saved(held.dropDuplicates(["doc_id", "pos"]), "candidate-lines")
    other = held.select(F.col("doc_id").alias("doc_id2"), F.col("pos").alias("pos2"), F.col("w").alias("w2"))
    both = pairs.join(held, ["doc_id", "pos"]).join(other, ["doc_id2", "pos2"]).withColumn("shared", F.size(F.array_intersect("w", "w2")))
    return saved(both.where(100 * F.col("shared") >= SIMILARITY * (F.size("w") + F.size("w2") - F.col("shared"))).select("doc_id", "pos").distinct(), "gone")


def line_flags(docs: DataFrame) -> DataFrame:
    """doc_id (a null as the least integer) and the positions of the lines that go."""
    levels = saved(rarity(docs), "rarity")
    sets = line_sets(lines(docs), levels)
    prefix = F.slice("keys", F.lit(1), F.expr(f"cast(n - ((n * {SIMILARITY} + 99) div 100) + 1 as int)"))
    digests = F.xxhash64("line").alias("s0"), F.xxhash64(F.lit(1), "line").alias("s1")
    row = F.monotonically_increasing_id().alias("row")
    whole = saved(sets.select(row, "doc_id", "pos", "n", *digests, _parity(0).alias("b0"), _parity(1).alias("b1"), prefix.alias("prefix")), "line-sets")
    marks = whole.select("row", "doc_id", "pos", "s0", "s1")
    leaders = saved(marks.groupBy("s0", "s1").agg(F.min(F.struct("doc_id", "pos", "row")).alias("f"), F.count("*").alias("c")), "line-leaders")
    groups = leaders.where("c > 1").select("s0", "s1", F.col("f.doc_id").alias("kd"), F.col("f.pos").alias("kp"))
    copies = saved(marks.join(_small(groups), ["s0", "s1"]).where("kd <> doc_id or kp <> pos").select("doc_id", "pos"), "line-copies")
    first = whole.join(leaders.select(F.col("f.row").alias("row")).hint("shuffle_hash"), "row", "left_semi")
    first = saved(first.select("doc_id", "pos", "n", "b0", "b1", "prefix"), "line-firsts")
    forget(whole)
    forget(leaders)

    # Only keys that may be hot by the counters are counted.
    leads = first.select("doc_id", "pos", "n", "b0", "b1", F.posexplode(F.slice("prefix", 1, LEADS)).alias("i", "key")).where(F.col("key") >= _HOT_KEY)
    hot = saved(leads.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot-keys")
    leads = leads.join(_small(hot), "key", "left_semi")
    own = F.struct("doc_id", "pos", "n", "b0", "b1", "i")
    # Every key has an order of its own, so that a line has other neighbours under each.
    around = Window.partitionBy("key").orderBy(F.xxhash64("key", "doc_id", "pos"), "doc_id", "pos")
    near = [F.lag(own, k).over(around) for k in range(1, NEAR + 1)]
    tried = leads.select(own.alias("p"), F.array(*near, F.min(own).over(Window.partitionBy("key"))).alias("near")).select("p", F.explode("near").alias("q")).where("q is not null")
    tried = tried.select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q"))
    settled = verified(docs, tried.where(_candidate("p", "q")).selectExpr(*_PAIR).distinct())

    flagged = first.join(_small(settled.withColumn("settled", F.lit(True))), ["doc_id", "pos"], "left").withColumn("open", F.col("settled").isNull())
    posted = postings(flagged.select("doc_id", "pos", "n", "b0", "b1", "open", "prefix"))
    posted = posted.select("meet", "doc_id", "b0", "b1", *[F.expr(e).alias(c) for c, e in _PACKED.items()])
    # The condition names open on both sides, so both are one exchange.
    asked = "(p.open or q.open and q.n < 0) and not (p.guest and q.guest)"
    amount = first.agg(F.sum(F.size("prefix"))).first()[0] or 0
    light = 2 * amount <= HASHED_ROWS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = posted.hint("shuffle_hash") if light else posted
    pairs = posted.alias("p").join(others.alias("q"), F.expr(_unpacked(f"p.meet = q.meet and {asked} and {_candidate('p', 'q')}")))
    pairs = pairs.selectExpr("p.doc_id", _unpacked("p.pos as pos"), "q.doc_id as doc_id2", _unpacked("q.pos as pos2")).distinct()
    gone = settled.unionByName(verified(docs, pairs)).distinct()
    return gone.unionByName(copies).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs without later similar lines, with two more columns of the internal prefix: lines that there were, and that went."""
    flags = saved(line_flags(docs), "line-flags").select(F.col("doc_id").alias(f"{P}id"), F.col("gone").alias(f"{P}gone"))
    at = docs.join(_small(flags, f"1 + size({P}gone) / 16"), _id(docs) == F.col(f"{P}id"), "left")
    parts = F.split(F.col("text").cast("string"), "\n")
    rows = at.withColumn(f"{P}parts", parts).withColumn(f"{P}lines", F.coalesce(F.size(f"{P}parts"), F.lit(0)).cast("long"))
    stay = F.when(F.col(f"{P}gone").isNotNull() & F.col("text").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(f"{P}parts") - 1), f"{P}gone"))
    rows = rows.withColumn(f"{P}stay", stay).withColumn(f"{P}went", F.coalesce(F.col(f"{P}lines") - F.size(f"{P}stay"), F.lit(0)).cast("long"))
    kept = F.when(F.col(f"{P}stay").isNull(), F.col("text").cast("string")).otherwise(F.array_join(F.transform(f"{P}stay", lambda i: F.get(f"{P}parts", i)), "\n"))
    return rows.select(*[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns], f"{P}lines", f"{P}went")
