"""Personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame operations only.

The fixed patterns give seed entities. Runs of identifier-like tokens and the words around them make a
graph of lexical patterns and instances. Spark scores patterns by the share of their distinct instances
that are known entities of one kind, instances by the patterns that hold them, until nothing new is known; what
high-confidence patterns hold and no fixed pattern has matched is added to the spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Kinds in the order of their spans.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The leftmost match of a run of equal characters begins with the run, or where the match before it
#: ended; said so, and with possessive repeats, the patterns take time in proportion to the text.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
GUARDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPACE = r"\x20\x09-\x0D"
_TOKEN = rf"[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
#: Tokens with a digit or an at sign, one blank between them.
RUN = rf"(?<![^{_SPACE}]){_TOKEN}(?:\x20{_TOKEN})*+"
#: A token, with what follows in one of the forms "a [at] b", "a (dot) b".
_WORD = rf"[^{_SPACE}]++(?:\x20[\[({{<][^{_SPACE}0-9@]{{1,8}}[\])}}>]\x20[^{_SPACE}0-9@]++(?![^{_SPACE}]))*+"
#: Every text is units with white space between: runs, and words.
UNIT = rf"(?:{RUN}|{_WORD})"
#: Words that stand for the start or end of a text, and for the run before or after.
EDGE, NEXT_RUN = "\x02", "\x03"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def prefix_sums(numbers: Column) -> Column:
    """Sums of the elements before each element of an array of ints, in n^1.5 steps."""

    def within(n: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(n))).cast("int")
        parts = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / w).cast("int")), lambda k: F.slice(n, k * w + 1, w)))
        return let(parts, lambda p: let(F.transform(p, _total), lambda sums: F.flatten(F.transform(p, lambda part, k: let(_total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(part, lambda _, j: base + _total(F.slice(part, F.lit(1), j))))))))

    return let(numbers, lambda n: F.when(F.size(n) > 0, within(n)).otherwise(F.array().cast("array<int>")))


def _matches(text: Column, pattern: str, row: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """row(match, start, gaps, index) of each match; starts are code points, gaps the texts between."""

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def rows(g: Column) -> Column:
            steps = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
            return let(prefix_sums(steps), lambda before: F.transform(m, lambda x, k: row(x, before[k] + F.length(g[k]), g, k)))

        return let(gaps, rows)

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is good."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<kind: int, start: int, end: int>> of the kind's fixed pattern, in order."""
    number = F.lit(KINDS.index(kind))
    found = _matches(text, PATTERNS[kind], lambda m, start, *_: F.struct(number.alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), _holds(kind, m).alias("ok")))
    guard = F.contains(text, F.lit(GUARDS[kind])) if GUARDS[kind] else F.lit(True)
    if kind != "email":
        guard = guard & text.rlike("[0-9]")
    good = F.transform(F.filter(found, lambda s: s["ok"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(guard, good).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int>>"))


def _core(unit: Column) -> tuple[Column, Column]:
    """A unit without punctuation around it, and how much stands before."""
    return F.regexp_extract(unit, r"""^[("'\[{<]*+(.*?)[)"'\]}>.,;:!?]*$""", 1), F.length(F.regexp_extract(unit, r"""^[("'\[{<]*+""", 0))


def word_places(rows: DataFrame) -> DataFrame:
    """doc_id, doc_hash, unit_no, word, pattern (a hash) of all units of rows (doc_id, doc_hash, text) but
    runs, in the patterns that _contexts makes."""
    units = F.regexp_extract_all("text", F.lit(UNIT), 0)
    run = lambda x: x.rlike(rf"^{_TOKEN}")

    def seen(u: Column) -> Column:
        return F.transform(u, lambda x: F.when(run(x), F.struct(F.lit(NEXT_RUN).alias("first"), F.lit(NEXT_RUN).alias("last"), F.lit(True).alias("run"))).otherwise(F.struct(F.lower(F.substring_index(x, " ", 1)).alias("first"), F.lower(F.substring_index(x, " ", -1)).alias("last"), F.lit(False).alias("run"))))

    def places(u: Column) -> Column:
        def row(m: Column, x: Column, k: Column) -> Column:
            last = F.when(k == 0, EDGE).otherwise(F.get(m, k - 1)["last"])
            two = F.when(k == 1, EDGE).otherwise(F.get(m, k - 2)["last"])
            after = F.coalesce(F.get(m, k + 1)["first"], F.lit(EDGE))
            left = F.when(~last.isin(EDGE, NEXT_RUN), F.xxhash64(F.concat(F.lit("2 "), two, F.lit(" "), last)))
            return F.struct(k.alias("unit_no"), x.alias("word"), m[k]["run"].alias("run"), F.array(left, F.xxhash64(F.concat(F.lit("0 "), last)), F.xxhash64(F.concat(F.lit("1 "), last, F.lit(" _ "), after))).alias("patterns"))

        return let(seen(u), lambda m: F.transform(u, lambda x, k: row(m, x, k)))

    each = rows.select("doc_id", "doc_hash", F.explode(let(units, places)).alias("p")).where("not p.run")
    each = each.select("doc_id", "doc_hash", "p.unit_no", "p.word", F.explode("p.patterns").alias("pattern"))
    return each.where("pattern is not null")


def _contexts(text: Column) -> Column:
    """Runs of identifier-like tokens, without punctuation around them, with the words about them: two and
    one before, and one on either side. The edges of the text and the runs next to it count as words."""

    def row(m: Column, start: Column, gaps: Column, k: Column) -> Column:
        core, lead = _core(m)
        mark = F.when(k == 0, EDGE).otherwise(NEXT_RUN)
        # the end of a long gap will do if it holds two whole words, and so does the start of one with a whole word
        word, space = rf"[^{_SPACE}]", rf"[{_SPACE}]"
        end, start_ = F.right(gaps[k], F.lit(96)), F.left(gaps[k + 1], F.lit(48))
        enough = (F.length(gaps[k]) > 96) & end.rlike(f"{space}{word}++{space}++{word}++{space}++$")
        before = F.when(enough, end).otherwise(F.concat(mark, F.lit(" "), gaps[k]))
        mark = F.when(k + 2 == F.size(gaps), EDGE).otherwise(NEXT_RUN)
        enough = (F.length(gaps[k + 1]) > 48) & start_.rlike(f"^{word}*+{space}++{word}++{space}")
        after = F.when(enough, start_).otherwise(F.concat(gaps[k + 1], F.lit(" "), mark))
        before, after = F.lower(before), F.lower(after)
        words = rf"([^{_SPACE}]+)[{_SPACE}]+([^{_SPACE}]+)[{_SPACE}]+$"
        last = F.regexp_extract(before, rf"([^{_SPACE}]+)[{_SPACE}]+$", 1)
        nearby = F.regexp_extract(after, rf"^[^{_SPACE}]*[{_SPACE}]+([^{_SPACE}]+)", 1)
        return F.struct(
            (start + lead).alias("start"), F.length(core).alias("length"), core.alias("instance"),
            F.when(before.rlike(words), F.concat(F.lit("2 "), F.regexp_extract(before, words, 1), F.lit(" "), last)).alias("left"),
            F.when(last != "", F.concat(F.lit("0 "), last)).alias("one"),
            F.when((last != "") & (nearby != ""), F.concat(F.lit("1 "), last, F.lit(" _ "), nearby)).alias("around"),
        )

    kind = "array<struct<start:int,length:int,instance:string,left:string,one:string,around:string>>"
    return F.when(text.rlike("[0-9@]"), _matches(text, RUN, row)).otherwise(F.array().cast(kind))


def _seed_kind(instance: Column) -> Column:
    """The first kind whose fixed pattern has a good match within the instance, else null."""

    def has(kind: str) -> Column:
        return F.exists(F.regexp_extract_all(instance, F.lit(PATTERNS[kind]), 0), lambda m: _holds(kind, m))

    return F.coalesce(*[F.when(has(k), F.lit(i)) for i, k in enumerate(KINDS)])


def _few(rows: DataFrame, most: int = 1 << 18) -> tuple[int, DataFrame]:
    """rows, a narrow table that is written already, and their number; sent to all tasks if there are at
    most so many."""
    n = rows.count()
    return n, F.broadcast(rows) if n <= most else rows


def discovered(found: DataFrame, texts: DataFrame, least_known: int = 4, least_share: float = 0.8, least_score: float = 0.9) -> DataFrame:
    """doc_id, doc_hash, kind, start, end of what patterns find beyond the fixed ones.

    found has a row per occurrence of a run: doc_id, doc_hash, start, length, instance, left, one,
    around; texts has doc_id, doc_hash, text. A pattern counts if least_known distinct known instances
    of a kind or more are least_share or more of its distinct instances, words in its place included; a
    pattern that counts by its runs is sought in all texts for that. An instance becomes known if the
    chance that one of its patterns is right is least_score or more, taking shares as chances; for
    words without a digit or at sign, the best pattern alone must reach it. Rounds go on until no
    instance becomes known.

    Patterns and instances go as hashes of 64 bits, and distinct pairs are counted, in two steps, so a
    frequent pattern or instance is no hot group. Words are counted over all texts, and only their hashes
    are kept; where they stand is looked up once it is known which count."""
    rows = found.where("instance != ''").select("*", F.xxhash64("instance").alias("i"), F.explode(F.array("left", "one", "around")).alias("text_")).where("text_ is not null").withColumn("p", F.xxhash64("text_"))
    edges = cut_lineage(rows.select("p", "i").distinct())
    known = cut_lineage(rows.groupBy("i").agg(F.min("instance").alias("instance")).select("i", _seed_kind(F.col("instance")).alias("kind"), F.lit(True).alias("digits")))
    seeds, sought = known.where("kind is not null").select("i"), None
    while True:  # sought and known only grow, so this ends
        held = edges.join(known, "i").groupBy("p").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(len(KINDS))])
        most = F.greatest(*[F.col(f"n{k}") for k in range(len(KINDS))])
        best = F.coalesce(*[F.when(F.col(f"n{k}") == most, k) for k in range(len(KINDS))])
        strong = held.where((most >= least_known) & (most >= least_share * F.col("n"))).select("p", best.alias("its"), (most / (F.col("n") + 1)).alias("share"))
        strong = cut_lineage(strong)
        fresh = strong.select("p")
        fresh = cut_lineage(fresh if sought is None else fresh.join(sought, "p", "left_anti"))
        n, some = _few(fresh)
        if n:
            sought = fresh.select("p") if sought is None else sought.union(fresh.select("p"))
            more = word_places(texts).join(some, F.col("pattern") == F.col("p"), "left_semi").select(F.col("pattern").alias("p"), _core(F.col("word"))[0].alias("instance"))
            more = cut_lineage(more.where("instance != ''").select("p", F.xxhash64("instance").alias("i")).distinct())
            edges = edges.union(more)
            others = more.select("i").distinct().join(known.select("i"), "i", "left_anti")
            known = cut_lineage(known.union(others.select("i", F.lit(None).cast("int").alias("kind"), F.lit(False).alias("digits"))))
            continue
        new = edges.join(known.where("kind is null").select("i", "digits"), "i").join(strong, "p")
        score = F.when(F.max("digits"), 1 - F.exp(F.sum(F.log1p(-F.col("share"))))).otherwise(F.max("share"))
        new = new.groupBy("i", "its").agg(score.alias("score")).where(F.col("score") >= least_score)
        new = cut_lineage(new.groupBy("i").agg(F.max_by("its", F.struct("score", -F.col("its"))).alias("new")))
        if not new.limit(1).count():
            break
        known = cut_lineage(known.join(new, "i", "left").select("i", F.coalesce("kind", "new").alias("kind"), "digits"))
    taken = cut_lineage(known.where("kind is not null").join(seeds, "i", "left_anti").select("i", "kind"))
    hits = rows.join(taken, "i").join(strong.select("p", "its"), "p").where("kind = its")
    hits = hits.select("doc_id", "doc_hash", "kind", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    n, some = _few(taken)
    if sought is None or not n:
        return hits
    # where the words that are known now stand, in the place of patterns that still count
    _, its = _few(strong.select("p", "its"))
    words = word_places(texts).join(its, F.col("pattern") == F.col("p")).select("doc_id", "doc_hash", "unit_no", "its", _core(F.col("word"))[0].alias("instance"))
    words = words.select("doc_id", "doc_hash", "unit_no", "its", F.xxhash64("instance").alias("i"), F.length("instance").alias("size"))
    there = words.join(some, "i").where("kind = its and size > 0")
    there = there.select(F.col("doc_id").alias("id"), F.col("doc_hash").alias("h"), "unit_no", "size", "kind").distinct()
    there = texts.dropDuplicates(["doc_id", "doc_hash"]).join(there, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_hash") == F.col("h")))
    skip = F.concat(F.lit(rf"^(?:[{_SPACE}]*+{UNIT}){{"), F.col("unit_no").cast("string"), F.lit(rf"}}+[{_SPACE}]*+[(\"'\[{{<]*+"))
    start = F.length(F.call_function("regexp_extract", F.col("text"), skip, F.lit(0)))
    return hits.union(there.select("doc_id", "doc_hash", "kind", start.alias("start"), (start + F.col("size")).alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_found of every row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by kind and start; base_spans are those of
    the fixed patterns, spans also those that contexts found (never overlapping base ones; n_found
    counts them). Null is an empty text, and has no spans. Repeated rows and null ids stay; rows with
    the same id and text share what contexts find. Other columns are ignored, an empty table gives
    no rows. Texts are read once for spans and runs, again for the words in the place of strong
    patterns, and where such words are found once more for their places; what goes on is narrow: spans, and instances with the words next to them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    texts = rows.select("doc_id", F.xxhash64("text").alias("doc_hash"), "text")
    kinds = [base_spans(F.col("text"), k).alias(k) for k in KINDS]
    rows = cut_lineage(rows.select("doc_id", F.xxhash64("text").alias("doc_hash"), *kinds, _contexts(F.col("text")).alias("runs")))
    found = rows.where(F.size("runs") > 0).select("doc_id", "doc_hash", F.explode("runs").alias("r")).select("doc_id", "doc_hash", "r.*")
    more = discovered(found, texts).groupBy("doc_id", "doc_hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    more = more.select(F.col("doc_id").alias("id"), F.col("doc_hash").alias("h"), "more")
    out = rows.drop("runs").join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_hash") == F.col("h")), "left")
    out = out.withColumn("base", F.concat(*KINDS))
    extra = F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], _joined(F.col("base")).alias("base_spans"),
        _joined(F.array_sort(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_found"),
    )
