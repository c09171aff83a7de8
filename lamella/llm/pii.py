"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Exact rules find base entities, which are the seeds.  The words left or right of an entity are lexical patterns; candidates that
look like identifiers, with blanks in them or not, and stand in such a context are its other instances.  Spark scores the bipartite graph of patterns and
instances in turns: a pattern by the share of its instances that are believed, an instance by its patterns.  Unseen tokens
of patterns with high confidence become spans of the pattern's kind; base spans are never changed.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lamella.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The base rules, in a form that Java matches without backtracking: the same leftmost, non-overlapping matches.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",  # shorter runs fail anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP = r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.|$)){4}$"
#: A token of 5 characters or more with a digit or an at sign; what an identifier may look like.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{5,}+"
_UNIT, _AREA = r"[0-9xX*]{1,8}+(?![A-Za-z0-9*@])", r"\([0-9xX*]{1,5}+\)"
#: Groups of digits, x and stars, bracketed or not, with single blanks, dots, hyphens or slashes between; possessive, so that Java loops.
GROUPS = rf"(?<![A-Za-z0-9*@+.\-/])\+?(?:{_UNIT}|{_AREA})(?:(?:[ .\-/]|(?<=\)))(?:{_UNIT})|[ .\-/]?(?:{_AREA}))++"
#: A mail address whose at sign is spelled out, with or without blanks around.
SPELLED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: What an unseen token must look like to be of a kind.
LOOKS = {
    "email": r"(?i)^[^\s@]+(@| ?(\[at\]|\(at\)) ?)[^\s@]+$", "ip": r"^[0-9]+([.:\[\]dot()]+[0-9]+){3}$|^[0-9a-fA-F]*(:[0-9a-fA-F]*){3,7}$",
    "card": r"^[0-9xX*]([ .-]?[0-9xX*]){11,18}$", "phone": r"^\+?[0-9(][0-9().\-/]{6,18}[0-9]$|^(?=[^ ]+ )\+?(\D{0,2}[0-9]){7,15}$",
}
#: Texts are cut into blocks of 2 to this many code points.
BLOCK_BITS = 10


@dataclass(frozen=True)
class Trust:
    """``rounds`` of scoring; a pattern counts from ``min_seeds`` believed instances on; ``confidence`` to discover."""
    rounds: int = 3
    min_seeds: int = 3
    confidence: float = 0.75


def running(a: str, op) -> Column:
    """Running ``op`` (associative, of two columns) over the array column ``a``: doubling steps, so n log n for n elements."""
    steps = F.filter(F.array(*[F.lit(1 << b) for b in range(31)]), lambda k: k < F.size(a))
    return F.aggregate(steps, F.col(a), lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, op(F.get(acc, i - k), x)).otherwise(x)))


def with_spans(d: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds for each name: start, end (code points, exclusive) and text of each match of its rule in ``text``, where its condition
    holds; else none.  Linear but for a logarithm in the matches, however many one text has."""
    col = lambda kind, k: f"_{kind}_{k}"
    d = d.withColumns({col("found", k): F.coalesce(F.when(when, F.regexp_extract_all("text", F.lit(rule), 0)), F.array().cast("array<string>")) for k, (rule, when) in rules.items()})
    # the texts between matches give the places
    d = d.withColumns({col("gaps", k): F.when(F.size(col("found", k)) > 0, F.split("text", rule, -1)).otherwise(F.array().cast("array<string>")) for k, (rule, _) in rules.items()})
    d = d.withColumns({col("end", k): F.zip_with(F.slice(col("gaps", k), 1, F.size(col("found", k))), col("found", k), lambda g, m: F.length(g) + F.length(m)) for k in rules})
    d = d.withColumns({col("end", k): running(col("end", k), lambda x, y: x + y) for k in rules})
    d = d.withColumns({k: F.zip_with(col("found", k), col("end", k), lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"))) for k in rules})
    return d.drop(*[col(kind, k) for kind in ("found", "gaps", "end") for k in rules])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digits ``d`` pass Luhn's check."""
    value = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return m.rlike(IP)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _fits(kind: str):
    return lambda x: valid(kind, x["m"])


def _as_kind(number: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e"))


def listed(s: Column) -> Column:
    """Spans (structs ``s, k, e``) as text: kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(s), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, text``, an array of valid spans for each kind, and ``tokens``: identifier-like candidates outside them.

    A candidate is a token or a run of groups with blanks in it (``wide``); ``run`` is the start of the run it lies in, or its own.
    """
    d = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    digit, at = F.col("text").rlike("[0-9]"), F.instr("text", "@") > 0
    spelled = F.instr(F.lower("text"), "at]") + F.instr(F.lower("text"), "at)") > 0
    need = {"email": at, "ip": digit & (F.instr("text", ".") > 0), "card": digit, "phone": digit & (F.instr("text", "+") > 0)}
    d = with_spans(d, {**{k: (RULES[k], need[k]) for k in KINDS}, "tokens": (TOKEN, digit | at), "wide": (GROUPS, digit), "spelled": (SPELLED, spelled)})
    d = d.withColumns({k: F.filter(k, _fits(k)) for k in KINDS})
    # without brackets and quotes around and stops behind
    lead, tail = (lambda m: F.length(F.regexp_extract(m, r"^[\"'(\[<{]*", 0))), (lambda m: F.length(F.regexp_extract(m, r"[\"')\]>}.,;:!?]*$", 0)))
    bare = F.transform("tokens", lambda x: F.struct(
        (x["s"] + lead(x["m"])).alias("s"), (x["e"] - tail(x["m"])).alias("e"), F.regexp_replace(F.regexp_replace(x["m"], r"^[\"'(\[<{]+", ""), r"[\"')\]>}.,;:!?]+$", "").alias("m")))
    groups = F.filter("wide", lambda t: t["m"].contains(" ") & t["m"].rlike("(?:[^0-9]*+[0-9]){5}"))
    # all by start; of one start, base spans first, then runs, then tokens
    ordered = lambda a, rank: F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.when(F.lit(rank > 0), x["m"]).alias("m")))
    d = d.withColumn("_all", F.sort_array(F.concat(*[ordered(k, 0) for k in KINDS], ordered(F.concat(groups, "spelled"), 1), ordered(bare, 2))))
    d = beside(d.drop("wide", "spelled"), "_all", 0)
    d = d.withColumn("_all", F.filter("_all", lambda x: (x["rank"] > 0) & (x["e"] - x["s"] >= 5) & (x["before"] <= x["s"]) & (x["after"] >= x["e"])))
    d = beside(d, "_all", 1)
    run = lambda x: F.when(x["rank"] == 1, x["s"]).when(x["before"] > x["s"], x["start"]).when(x["after"] < x["e"], x["after"]).otherwise(x["s"])
    return d.withColumn("tokens", F.transform("_all", lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), run(x).alias("run"), (x["rank"] == 1).alias("wide")))).drop("_all")


def beside(d: DataFrame, a: str, rank: int) -> DataFrame:
    """For each of the spans ``a``, sorted by start, among those of ``rank``: the largest end of one that starts no later (``before``,
    with its start), and the next start (``after``)."""
    d = d.withColumns({"_before": F.transform(a, lambda x: F.when(x["rank"] == rank, x["e"].cast("long") * (1 << 32) + x["s"]).otherwise(F.lit(0).cast("long"))),
                       "_after": F.reverse(F.transform(a, lambda x: F.when(x["rank"] == rank, x["s"]).otherwise(F.lit((1 << 31) - 1))))})
    d = d.withColumns({"_before": running("_before", F.greatest), "_after": F.reverse(running("_after", F.least))})
    more = F.zip_with("_before", "_after", lambda x, y: F.struct(F.shiftright(x, 32).cast("int").alias("before"), (x % (1 << 32)).cast("int").alias("start"), y.alias("after")))
    return d.withColumn(a, F.zip_with(a, more, lambda x, y: F.struct(
        *[x[c].alias(c) for c in ("s", "rank", "e", "m")], *[y[c].alias(c) for c in ("before", "start", "after")]))).drop("_before", "_after")


def window(blocks: str, start: Column, n: Column) -> Column:
    """``n`` (at most a block's) code points of a text from ``start`` on, without a walk through the text: of its ``blocks``."""
    at = F.shiftright(start, BLOCK_BITS)
    near = F.concat(F.coalesce(F.get(blocks, at), F.lit("")), F.coalesce(F.get(blocks, at + 1), F.lit("")))
    return F.substring(near, start - F.shiftleft(at, BLOCK_BITS) + 1, n)


def contexts(blocks: str, s: Column, e: Column) -> Column:
    """The patterns of an entity from ``s`` to ``e``, lower case: the last word before it and the last two; the next word and
    the next two, which begin with a blank."""
    left = window(blocks, F.greatest(s - 80, F.lit(0)), F.least(s, F.lit(80)))
    word = r"(\S{1,40})\s+$"
    one, two = F.lower(F.regexp_extract(left, word, 1)), F.lower(F.regexp_extract(left, r"(?:^|\s)(\S{1,40}\s+\S{1,40})\s+$", 1))
    # long enough that no word is cut at the window's end
    right = window(blocks, e, F.lit(120))
    behind = r"^[\"')\]>}.,;:!?]{0,4}(\s{1,8}\S{1,40})(?!\S)", r"^[\"')\]>}.,;:!?]{0,4}(\s{1,8}\S{1,40}\s{1,8}\S{1,40})(?!\S)"
    after = [F.lower(F.regexp_extract(right, r, 1)) for r in behind]
    return F.filter(F.array(one, *[F.regexp_replace(p, r"\s+", " ") for p in (two, *after)]), lambda p: p != "")


def graph(occ: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """``pattern, kind, confidence`` after ``rounds`` turns. ``occ``: ``kind`` (null for candidates), ``token, patterns``.

    Both sides are only ever aggregated, combined before each exchange; a pattern or a token that holds a third of all rows
    is one row for each task.
    """
    edges = written(occ.select("token", F.explode("patterns").alias("pattern")).distinct())
    size = written(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    seeds = written(occ.where("kind IS NOT NULL").select("token", "kind", F.lit(1.0).alias("score")).distinct())
    believed = seeds
    for turn in range(trust.rounds):
        part = edges.join(believed, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        pattern = written(part.join(size, "pattern").where(F.col("sum") >= trust.min_seeds)
                          .select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("confidence")))
        if turn + 1 < trust.rounds:
            strong = pattern.where(F.col("confidence") >= trust.confidence / 2)
            other = (edges.join(strong, "pattern").groupBy("token", "kind")
                     .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")))
            believed = written(seeds.unionByName(other.join(seeds, ["token", "kind"], "left_anti")))
    return pattern


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust: Trust = Trust()) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, base_spans, spans``.

    Counts and ``base_spans`` are the base rules'; ``spans`` adds what the patterns discover.  A null or empty text has none.
    Repeated rows get the same spans.
    """
    d = base(docs, id_col, text_col)
    size = 1 << BLOCK_BITS
    d = d.withColumn("_blocks", F.when(F.length("text") > size, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), 0)).otherwise(F.array("text")))
    # contexts beside the spans, so that the text itself need not be kept
    with_context = lambda x: [x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), contexts("_blocks", x["s"], x["e"]).alias("c")]
    d = d.withColumns({**{k: F.transform(k, lambda x: F.struct(*with_context(x))) for k in KINDS},
                       "tokens": F.transform("tokens", lambda x: F.struct(*with_context(x), x["run"].alias("run"), x["wide"].alias("wide")))})
    d = written(d.drop("text", "_blocks"))
    seen = [d.select(F.lit(k).alias("kind"), F.explode(k).alias("x")) for k in KINDS]
    tokens = d.select("id", "h", F.explode("tokens").alias("x"))
    occ = tokens.select(F.lit(None).cast("string").alias("kind"), F.struct("x.s", "x.e", "x.m", "x.c").alias("x"))
    for s in seen:
        occ = occ.unionByName(s)
    occ = occ.select("kind", F.col("x.m").alias("token"), F.col("x.c").alias("patterns"))
    sure = written(graph(occ, trust).where(F.col("confidence") >= trust.confidence))
    looks = F.coalesce(*[F.when(F.col("kind") == k, F.col("token").rlike(r)) for k, r in LOOKS.items()])
    place = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    # of a run and the tokens in it: the tokens if one of them is a whole number by itself, else the run
    whole = ~F.col("wide") & (F.length(digits(F.col("token"))) >= 9)
    pick = F.filter("all", lambda x: F.when(F.col("any_whole"), ~x["wide"]).when(F.col("any_wide"), x["wide"]).otherwise(True))
    new = (tokens.select("id", "h", "x.s", "x.e", "x.run", "x.wide", F.col("x.m").alias("token"), F.explode("x.c").alias("pattern")).join(sure, "pattern").where(looks)
           .groupBy("id", "h", "run", "s", "e").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("wide").alias("wide"), F.max(whole).alias("whole"))
           .groupBy("id", "h", "run").agg(F.collect_list(F.struct("s", place.alias("k"), "e", "wide")).alias("all"), F.max("whole").alias("any_whole"), F.max("wide").alias("any_wide"))
           .select("id", "h", F.explode(pick).alias("x"))
           .groupBy("id", "h").agg(F.collect_set(F.struct("x.s", "x.k", "x.e")).alias("more")))
    new = written(new).withColumnRenamed("id", "_id")
    own = F.concat(*[F.transform(k, _as_kind(i)) for i, k in enumerate(KINDS)])
    d = d.withColumn("own", own).join(new, (d["h"] == new["h"]) & d["id"].eqNullSafe(new["_id"]), "left")
    both = F.concat("own", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>")))
    return d.select(F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("own")), 256).alias("base_sha256"),
                    listed(F.col("own")).alias("base_spans"), listed(both).alias("spans"))
