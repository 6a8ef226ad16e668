"""Personal data: fixed patterns, then bootstrapped contextual extraction. No Python in tasks.

*Seeds* are what four fixed patterns find (e-mail, IP address, payment card, phone). The
word before an entity is a lexical pattern for its kind. Tokens that hold a digit or an
``@`` and no seed are candidates. Patterns and instances form a graph that Spark scores in
rounds:

- a pattern's confidence for a kind is the share of its occurrences, over all words of
  all texts, that are followed by a known instance of the kind;
- patterns with ``support`` known instances or more and a confidence of ``confident`` or
  more vouch for the candidates that follow them;
- a candidate's score is ``1 - product(1 - confidence)`` over its patterns; candidates that
  reach ``confident`` become known instances and keep the kind of their best score;
- known instances make new patterns confident, so rounds go on until one finds nothing new.

All occurrences of an instance found so are added as spans of its kind; seed spans stay as
they are, and a candidate never overlaps one. Texts are read twice (spans, word counts);
the graph holds only words that could be confident if all their candidates were known.
Counts of common words are added up before they move; a busy pattern or instance is only
ever summed.

Positions are code points, ends exclusive; they are running sums in a text, so a text
of many matches costs no more than their number. Nulls: a null text is empty and has no spans; a
null ``doc_id`` is kept; repeated rows are rows of their own; extra columns are ignored;
an empty table gives no rows.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import new_folder, stored

KINDS = ("email", "ip", "card", "phone")
_S = r"\x20\x09-\x0D"
_L = "A-Za-z0-9._%+-"
#: The fixed patterns. Possessive loops and start conditions keep them linear on long
#: runs; they find what the plain patterns find, leftmost and without overlap.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=(?:[ -]?[0-9]){12})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = rf"(?<![^{_S}])[^{_S}0-9@]*+[0-9@][^{_S}]*+"
LAST_WORD = rf"(?<![^{_S}])([^{_S}]++)[{_S}]*+$"
MATCH = "struct<kind:int,gap:int,text:string,last_word:string>"
#: Shorter tokens are no identifiers.
LEAST = 5


def _matches(text, pattern, number):
    """Matches of ``pattern`` in order, with the length of the gap before each and its last word."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.zip_with(
        F.slice(gaps, 1, F.size(found)), found,
        lambda g, m: F.struct(
            F.lit(number).alias("kind"), F.length(g).alias("gap"), m.alias("text"), F.regexp_extract(g, LAST_WORD, 1).alias("last_word")
        ),
    )


def _digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits):
    """Whether the check sum of a digit string is right."""
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind, text):
    if kind == "ip":
        parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    digits = _digits(text)
    if kind == "card":
        size = F.length(digits)
        return F.when((size >= 12) & (size <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches_of(docs):
    """``doc_id`` and all matches of every text, seeds' kinds and candidates (kind -1), row by row."""
    none = F.array().cast(f"array<{MATCH}>")
    text, digit = F.col("text"), F.col("has_digit")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("has_digit", text.rlike("[0-9]"))
    at = text.contains("@")
    needs = {"email": at, "ip": digit, "card": digit, "phone": digit & text.contains("+")}
    parts = [F.when(needs[k], _matches(text, PATTERNS[k], i)).otherwise(none) for i, k in enumerate(KINDS)]
    parts.append(F.when(digit | at, _matches(text, CANDIDATE, -1)).otherwise(none))
    return base.select("doc_id", F.xxhash64(text).alias("text_hash"), F.concat(*parts).alias("matches"))


def spans_of(rows):
    """``uid, kind, start, end, instance, pattern`` of the valid seeds and free candidates in ``rows``.

    Positions are running sums over the matches of one kind in one text.
    """
    one = rows.select("uid", F.posexplode("matches").alias("at", "m")).select("uid", "at", "m.*")
    order = W.partitionBy("uid", "kind").orderBy("at")
    size = F.length("text")
    one = one.withColumn("end", F.sum(F.col("gap") + size).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    # without a word in the gap the word before is the end of the match before
    last = F.when(F.col("last_word") == "", F.regexp_extract(F.lag("text").over(order), LAST_WORD, 1)).otherwise(F.col("last_word"))
    one = one.withColumn("last_word", F.coalesce(last, F.lit(""))).withColumn("start", F.col("end") - size)
    valid = F.when(F.col("kind") == -1, F.length("text") >= LEAST)
    for i, kind in enumerate(KINDS):
        valid = valid.when(F.col("kind") == i, _valid(kind, F.col("text")))
    one = one.filter(valid)
    # a candidate is free if no seed begins in it and none before reaches into it
    seed_end = F.when(F.col("kind") >= 0, F.col("end"))
    seed_start = F.when(F.col("kind") >= 0, F.col("start"))
    here = W.partitionBy("uid").orderBy("start")
    free = (F.coalesce(F.max(seed_end).over(here.rangeBetween(W.unboundedPreceding, 0)), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(seed_start).over(here.rangeBetween(0, W.unboundedFollowing)), F.lit(2**31 - 1)) >= F.col("end")
    )
    one = one.withColumn("free", free).filter("kind >= 0 OR free")
    short = F.when(F.col("kind") >= 0, F.col("text")).otherwise(F.regexp_replace("text", r"[.,;:!?\"')\]}>]+$", ""))
    word = F.lower("last_word")
    return one.withColumn("text", short).filter(F.length("text") > 0).select(
        "uid", "kind", "start", (F.col("start") + F.length("text")).alias("end"), F.xxhash64(F.lower("text")).alias("instance"),
        F.when(word == "", F.lit(0).cast("long")).otherwise(F.xxhash64(word)).alias("pattern"),
    )


def word_counts(docs, words):
    """How often each of the lower-case word hashes in ``words.pattern`` stands in all texts."""
    text = F.lower(F.coalesce(docs["text"].cast("string"), F.lit("")))
    every = docs.select(F.explode(F.transform(F.split(text, rf"[{_S}]+"), lambda w: F.xxhash64(w))).alias("pattern"))
    return every.groupBy("pattern").agg(F.count("*").alias("total")).join(words, "pattern")


def bootstrap(spans, docs, support=3, confident=0.6, rounds=None):
    """``instance, kind`` of the candidates that confident patterns vouch for.

    Rounds go on until one finds nothing new, or for ``rounds`` of them.
    """
    edges = spans.filter("pattern != 0").groupBy("kind", "instance", "pattern").agg(F.count("*").alias("n"))
    # bounds that hold whatever is found later: every neighbour of a word taken as known
    words = edges.groupBy("pattern").agg(F.sum("n").alias("most"), F.countDistinct("instance").alias("k"), F.min("kind").alias("least"))
    words = words.filter((F.col("k") >= support) & (F.col("least") < 0)).select("pattern", "most")
    totals = word_counts(docs, words).filter(F.col("most") / F.col("total") >= confident).select("pattern", "total")
    totals = stored(totals, "pii-patterns")
    edges = stored(edges.join(totals.select("pattern"), "pattern", "left_semi"), "pii-edges")
    seeds, open_edges = edges.filter("kind >= 0"), edges.filter("kind < 0").drop("kind")
    spark, folder, paths = spans.sparkSession, new_folder(spans.sparkSession, "pii-known"), []
    known = spark.createDataFrame([], "instance long, kind int")
    while rounds is None or len(paths) < rounds:
        told = seeds.unionByName(open_edges.join(known, "instance").select("kind", "instance", "pattern", "n"))
        scores = (
            told.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.countDistinct("instance").alias("k")).join(totals, "pattern")
            .select("kind", "pattern", (F.col("n") / F.col("total")).alias("confidence"), "k")
            .filter((F.col("k") >= support) & (F.col("confidence") >= confident))
        )
        # every pattern here is confident, and so is what it vouches for
        reached = open_edges.join(known, "instance", "left_anti").join(scores, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score")
        )
        best = reached.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("less"), "kind")).alias("top"))
        paths.append(f"{folder}/{len(paths)}")
        best.select("instance", F.col("top.kind").alias("kind")).write.parquet(paths[-1])
        known = spark.read.schema(known.schema).parquet(*paths)
        if spark.read.schema(known.schema).parquet(paths[-1]).isEmpty():
            break
    return known


def find(docs, support=3, confident=0.6, rounds=None):
    """``doc_id``, ``text_hash``, ``base`` and ``spans``: arrays of (start, kind number, end), in order."""
    rows = stored(matches_of(docs).withColumn("uid", F.monotonically_increasing_id()), "pii-matches")
    spans = stored(spans_of(rows.select("uid", "matches")), "pii-spans")
    known = bootstrap(spans, docs, support, confident, rounds)
    more = spans.filter("kind < 0").drop("kind").join(known, "instance").select("uid", "kind", "start", "end", F.lit(False).alias("seed"))
    every = spans.filter("kind >= 0").select("uid", "kind", "start", "end", F.lit(True).alias("seed")).unionByName(more)
    every = every.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "seed"))).alias("all"))
    short = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,seed:boolean>>")
    both = rows.select("uid", "doc_id", "text_hash").join(every, "uid", "left").withColumn("all", F.coalesce("all", none))
    return both.select("doc_id", "text_hash", F.transform(F.filter("all", lambda s: s["seed"]), short).alias("base"), F.transform("all", short).alias("spans"))


def written(spans):
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(docs, **options):
    """``docs`` with every span of every text replaced by ``[KIND]``; same columns.

    Rows meet their spans by id and hash of the text, so repeated rows are masked alike.
    """
    docs = stored(docs, "pii-documents")
    found = find(docs, **options).filter(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("_spans"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"])
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(mask_text(F.col("text"), F.col("_spans")))
    return docs.join(found, same, "left").withColumn("text", text).select(*docs.columns)


def mask_text(text, spans):
    """``text`` with its spans replaced; spans that begin inside another one are part of it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def add(acc, s):
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        done = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, F.get(names, s["kind"]))).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], done).otherwise(longer)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, add, rest)).otherwise(text)
