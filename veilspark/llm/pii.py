"""Personal data in texts: checked base patterns, and bootstrapped contextual extraction of further identifiers.

All on DataFrame functions. One pass over the texts marks the matches of each pattern (``regexp_replace`` puts control
characters around them, ``split`` cuts there), so that only short rows leave that pass: a match, how far it stands from
the match before, and the words in front of it. They are written to the shared scratch folder; no text is shuffled.

Bootstrapping: the base matches are the seed entities. The one or two words in front of an entity are a lexical pattern.
All identifier-like tokens (with a digit or ``@``) are candidates. Each round scores a pattern for a kind by the share of
its distinct instances that are known to be of that kind, and an instance by the noisy-or of its patterns' scores;
patterns with at least SUPPORT known instances and a score of CONFIDENCE make their other instances known. After ROUNDS
rounds, candidates that are known instances or stand behind a confident pattern are added to the base spans, if they
overlap none.

Base patterns (kind: form; matches that fail the check are dropped, and the scan goes on behind them):
email; ip: four parts of at most 255; card: 16 to 19 digits that pass Luhn; phone: + and 8 to 15 digits.

Defined results: a null text is empty; control characters U+0001 and U+0002 read as U+0003, which no pattern contains;
offsets are code points; repeated rows are answered each; rows whose id is null are too; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, with possessive quantifiers where giving back can't help, and without starts inside a run that has failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CANDIDATE = r"(?:\G|(?<![^\s]))[^\s0-9@]*+[0-9@][^\s]*+"
ROUNDS, SUPPORT, CONFIDENCE, KNOWN = 3, 5, 0.9, 0.9
#: The last two words of a text that is read backwards.
LAST_WORDS = r"^\s*+\S++(?:\s++\S++)?+"


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, found: Column) -> Column:
    """Whether a base match stays."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    part = lambda x: F.length(F.regexp_replace(x, "^0+(?=.)", "")) <= 3
    ip = F.forall(F.split(found, r"\."), lambda x: F.when(part(x), F.regexp_replace(x, "^0+(?=.)", "").cast("int") <= 255).otherwise(False))
    card = F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", n.between(8, 15)).otherwise(False)


def marked(docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """Rows (uid, doc, kind, i, skip, found, before): i is 0 for what stands before the first match, kind null if a text has none."""
    clean = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\x01\x02", "\x03\x03")
    keep = [c for c in docs.columns if c != text]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.monotonically_increasing_id().alias("uid"), clean.alias("t"))
    base = base.withColumn("digit", F.col("t").rlike("[0-9@]"))
    tries = []
    for kind, pattern in [*PATTERNS.items(), ("candidate", CANDIDATE)]:
        may = F.col("digit")
        if hint := HINTS.get(kind):
            may &= F.contains("t", F.lit(hint))
        if kind == "card":
            may &= F.col("t").rlike(pattern)
        tries.append(F.struct(F.lit(kind).alias("kind"), F.when(may, F.regexp_replace("t", f"({pattern})", "\x01$1\x02")).alias("m")))
    some = F.filter(F.array(*tries), lambda x: F.coalesce(F.contains(x["m"], F.lit("\x01")), F.lit(False)))
    by_kind = base.select("doc", "uid", F.explode_outer(some).alias("k")).select("doc", "uid", "k.kind", F.posexplode_outer(F.split("k.m", "\x01")).alias("i", "piece"))
    found = F.when(F.col("i") > 0, F.substring_index("piece", "\x02", 1))
    rest = F.when(F.col("i") > 0, F.substring_index("piece", "\x02", -1)).otherwise(F.col("piece"))
    rows = by_kind.select("doc", "uid", "kind", "i", F.length(rest).cast("long").alias("skip"), found.alias("found"), F.reverse(F.regexp_extract(F.reverse(rest), LAST_WORDS, 0)).alias("tail"))
    return scratch.keep(rows, "marked")


def spans(rows: DataFrame) -> DataFrame:
    """(uid, kind, start, end, found, before) of all matches, base and candidates."""
    order = Window.partitionBy("uid", "kind").orderBy("i")
    width = F.coalesce(F.length("found"), F.lit(0)) + F.col("skip")
    at = rows.where("kind is not null").select("uid", "kind", "i", "found", F.sum(width).over(order).alias("end_all"), "skip", F.lag("tail").over(order).alias("before"))
    end = F.col("end_all") - F.col("skip")
    return at.where("i > 0").select("uid", "kind", (end - F.length("found")).alias("start"), end.alias("end"), "found", "before")


def instance(found: Column) -> Column:
    """Instances are compared without case and separators."""
    return F.lower(F.regexp_replace(found, r"[\s().-]", ""))


def patterns_of(before: Column) -> Column:
    """The last word before a match, and the last two; only words of letters or with a closing sign count."""
    low = F.lower(F.rtrim(F.coalesce(before, F.lit(""))))
    one, two = F.regexp_extract(low, r"(\S+)$", 1), F.regexp_extract(low, r"(?:^|\s)(\S+\s+\S+)$", 1)
    return F.filter(F.array(F.concat(F.lit("1:"), one), F.concat(F.lit("2:"), two)), lambda x: F.length(x) > 2)


def trimmed(rows: DataFrame) -> DataFrame:
    """Candidates without the signs around them; those with fewer than 4 digits and no @ go."""
    lead = F.length(F.regexp_extract("found", r"^[^A-Za-z0-9+@]*", 0))
    core = F.regexp_replace(F.regexp_replace("found", r"^[^A-Za-z0-9+@]+", ""), r"[^A-Za-z0-9]+$", "")
    out = rows.withColumn("lead", lead).withColumn("core", core).select("uid", (F.col("start") + F.col("lead")).alias("start"), (F.col("start") + F.col("lead") + F.length("core")).alias("end"), F.col("core").alias("found"), "before")
    return out.where((F.length(F.regexp_replace("found", "[^0-9]", "")) >= 4) | F.contains("found", F.lit("@")))


def bootstrap(base: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, kind, start, end) of candidates that confident patterns or known instances give a kind.

    The graph's rows are distinct (pattern, instance) pairs: counting them needs no group in one place.
    """
    seeds = base.select(instance(F.col("found")).alias("instance"), "kind").distinct()
    edges = base.select("before", "found").unionByName(candidates.select("before", "found"))
    edges = edges.select(F.explode(patterns_of(F.col("before"))).alias("pattern"), instance(F.col("found")).alias("instance")).distinct()
    edges = scratch.keep(edges, "edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total")).where(F.col("total") >= SUPPORT)
    known = scratch.keep(seeds, "seeds")
    strong = None
    for i in range(ROUNDS):
        scored = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("hits")).where(F.col("hits") >= SUPPORT).join(totals, "pattern")
        scored = scored.select("pattern", "kind", (F.col("hits") / F.col("total")).alias("score")).where(F.col("score") >= CONFIDENCE)
        strong = scratch.keep(scored, f"patterns{i}")
        reached = edges.join(strong, "pattern").groupBy("instance", "kind").agg(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999)))).alias("miss"))
        reached = reached.where(1 - F.exp("miss") >= KNOWN).select("instance", "kind")
        known = scratch.keep(known.unionByName(reached).distinct(), f"known{i}")
    # An instance of several kinds takes the first in the kinds' order.
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    kinds = known.groupBy("instance").agg(F.min_by("kind", rank).alias("kind"))
    return candidates.withColumn("instance", instance(F.col("found"))).join(kinds, "instance").select("uid", "kind", "start", "end")


def find(docs: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs' columns but the text under ``doc``; base and spans: arrays of (rank of the kind, start, end, kind), sorted."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = marked(docs, text, scratch)
    at = scratch.keep(spans(rows).where((F.col("kind") == "candidate") | passes(F.col("kind"), F.col("found"))), "spans")
    base, loose = at.where("kind <> 'candidate'"), trimmed(at.where("kind = 'candidate'"))
    # Candidates on base spans go: the base spans of a row are few, and meet only that row's candidates.
    taken = base.select("uid", F.col("start").alias("s"), F.col("end").alias("e"))
    loose = scratch.keep(loose.join(taken, (loose.uid == taken.uid) & (loose.start < taken.e) & (taken.s < loose.end), "left_anti"), "candidates")
    more = bootstrap(base, loose, scratch)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    nothing = F.lit(None).cast("struct<rank:int,start:bigint,end:bigint,kind:string>")
    heads = rows.where("kind is null or i = 0").select("uid", "doc", nothing.alias("b"), nothing.alias("s"))
    no_doc = F.lit(None).cast(rows.schema["doc"].dataType)
    parts = heads.unionByName(base.select("uid", no_doc.alias("doc"), span.alias("b"), span.alias("s"))).unionByName(more.select("uid", no_doc.alias("doc"), nothing.alias("b"), span.alias("s")))
    out = parts.groupBy("uid").agg(F.first("doc", ignorenulls=True).alias("doc"), F.array_sort(F.collect_list("b")).alias("base"), F.array_sort(F.collect_set("s")).alias("spans"))
    return out.drop("uid")


def listed(column: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, column: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    ordered = F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("last"))
    step = lambda a, s: F.struct(
        F.when(s["start"] < a["last"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, (a["last"] + 1).cast("int"), (s["start"] - a["last"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
        F.greatest(a["last"], s["end"]).alias("last"),
    )
    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["last"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of every text replaced.

    Texts with a digit or @ meet their spans by a digest of the whole text; the others are not moved. A null text stays null.
    """
    digest = F.sha2(F.col(f"`{text}`").cast("binary"), 256)
    may = F.coalesce(F.col(f"`{text}`").rlike("[0-9@]"), F.lit(False))  # else there is nothing to find
    docs, rest = docs.where(may), docs.where(~may)
    found = find(docs.select(digest.alias("digest"), F.col(f"`{text}`").alias(text)), text)
    found = found.where(F.size("spans") > 0).select(F.col("doc.digest").alias("digest"), "spans").dropDuplicates(["digest"])
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], digest.alias("digest"))
    done = plain.join(found, "digest", "left")
    fixed = F.when(F.col("spans").isNull(), F.col(names[text])).otherwise(redacted(F.col(names[text]), F.col("spans")))
    return done.select(*[(fixed if c == text else F.col(n)).alias(c) for c, n in names.items()]).unionAll(rest)
