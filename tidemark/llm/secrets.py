"""Secret scan with DataFrame functions only.

Three pattern kinds (``assign``, ``access``, ``hex``) are matched as stated in ``KINDS``.
On top of them a sliding window of ``WINDOW`` characters runs over every candidate string
(an unbroken run of token characters) and adds an ``entropy`` span wherever the window's
Shannon entropy reaches the bound of the candidate's character class. The window is a fold:
each step adds the character that enters and takes off the one that leaves from a vector
of counts, and the sum of c*log2(c) is updated from those two counts alone. It is kept in
whole millionths of a bit, so every engine draws the same line.

Defined results: a null text counts as empty and has no spans; repeated rows each get
their own result; a table without rows gives none; extra input columns are left out of
``scan`` results and kept by ``redact``. Every text is scanned to its end; work is linear in its
length apart from the summing of match offsets, which goes in blocks.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The kinds' patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Bits a window needs by character class: hexadecimal digits; anything wider.
BOUNDS = {"hex": 3.0, "wide": 3.8}
HEX_ONLY = r"^[0-9a-fA-F]+$"
#: A candidate that matches one of these gets no entropy span: words and names joined by
#: separators, plain numbers and dates, UUIDs, and stand-ins that documentation uses.
ALLOW = (
    r"^[A-Za-z]*([-_/=+][A-Za-z]*)*$",
    r"^[0-9]+([-_/=+][0-9]*)*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|xxxxxx",
)
UNIT = 1_000_000
BLOCK = 64


def weights(window: int = WINDOW) -> list[int]:
    """c*log2(c) for c = 0..window, in millionths."""
    return [0, 0] + [round(c * math.log2(c) * UNIT) for c in range(2, window + 1)]


def most(bits: float, window: int = WINDOW) -> int:
    """The largest sum of c*log2(c), in millionths, at which a window has ``bits`` of entropy."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _located(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """All matches as structs (s, m): start in code points, matched string. ``needs``: any
    match holds one of these characters, which are quicker to look for.

    The pieces between the matches give the offsets. Lengths are summed by blocks, so that
    thousands of matches in one text don't cost the square of their number.
    """
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(x: Column) -> Column:
        n = F.size(x["m"])
        return let(
            F.struct(
                x["m"].alias("m"),
                x["p"].alias("p"),
                F.zip_with(F.slice(x["p"], 1, n), x["m"], lambda p, m: F.length(p) + F.length(m)).alias("w"),
            ),
            before,
        )

    def before(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(x["m"]) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: _total(F.slice(x["w"], b * BLOCK + 1, F.lit(BLOCK))))
        return let(F.struct(x["m"].alias("m"), x["p"].alias("p"), x["w"].alias("w"), sums.alias("b")), starts)

    def starts(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.size(x["b"]) - 1)
        ahead = F.transform(blocks, lambda b: _total(F.slice(x["b"], F.lit(1), b)))
        return let(F.struct(x["m"].alias("m"), x["p"].alias("p"), x["w"].alias("w"), ahead.alias("a")), spans)

    def spans(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(x["a"], block) + _total(F.slice(x["w"], block * BLOCK + 1, i % BLOCK)) + F.length(F.get(x["p"], i))
            return F.struct(start.alias("s"), m.alias("m"))

        return F.transform(x["m"], one)

    empty = F.array().cast("array<struct<s:int,m:string>>")
    found = text.rlike(pattern)
    if needs:
        found = functools.reduce(operator.or_, [F.contains(text, F.lit(x)) for x in needs]) & found
    return F.when(found, let(F.struct(matches.alias("m"), pieces.alias("p")), place)).otherwise(empty)


def _windows(candidate: Column, bound: Column) -> Column:
    """Where ``candidate`` has windows that reach the bound: merged (from, to) pairs."""
    costs = F.array(*[F.lit(x) for x in weights()])
    chars = F.split(candidate, "")
    zeros = F.array_repeat(F.lit(0), len(ALPHABET))
    start = F.struct(zeros.alias("n"), F.lit(0).alias("sum"), F.array().cast("array<struct<f:int,t:int>>").alias("hits"))

    def slide(x: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            into = F.instr(F.lit(ALPHABET), F.get(x["c"], i)) - 1
            out = F.when(i >= WINDOW, F.instr(F.lit(ALPHABET), F.get(x["c"], i - WINDOW)) - 1).otherwise(F.lit(-1))
            return let(F.struct(state.alias("st"), into.alias("a"), out.alias("z"), i.alias("i")), update)

        def update(v: Column) -> Column:
            n, a, z, i = v["st"]["n"], v["a"], v["z"], v["i"]
            more = F.get(costs, F.get(n, a) + 1) - F.get(costs, F.get(n, a))
            less = F.when(z >= 0, F.get(costs, F.get(n, z) - 1) - F.get(costs, F.get(n, z))).otherwise(F.lit(0))
            total = v["st"]["sum"] + F.when(a == z, F.lit(0)).otherwise(more + less)
            counts = F.transform(n, lambda c, k: c + (k == a).cast("int") - (k == z).cast("int"))
            hits, first = v["st"]["hits"], i - (WINDOW - 1)
            last = F.get(hits, F.size(hits) - 1)
            joined = F.when(
                (F.size(hits) > 0) & (last["t"] >= first),
                F.concat(F.slice(hits, F.lit(1), F.size(hits) - 1), F.array(F.struct(last["f"].alias("f"), (i + 1).alias("t")))),
            ).otherwise(F.concat(hits, F.array(F.struct(first.alias("f"), (i + 1).alias("t")))))
            return F.struct(
                counts.alias("n"),
                total.alias("sum"),
                F.when((first >= 0) & (total <= x["b"]), joined).otherwise(hits).alias("hits"),
            )

        steps = F.sequence(F.lit(0), F.size(x["c"]) - 1)
        return F.aggregate(steps, start, step, lambda s: s["hits"])

    return let(F.struct(chars.alias("c"), bound.alias("b")), slide)


def _span(start: Column, end: Column, kind: str) -> Column:
    rank = F.lit((*KINDS, "entropy").index(kind))
    return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


def _whole(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: _span(x["s"], x["s"] + F.length(x["m"]), kind))


def base_spans(text: Column) -> Column:
    """The pattern kinds' spans, sorted by start and then by kind."""
    assigned = F.filter(_located(text, ASSIGN, (":", "=")), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(_whole(assigned, "assign"), _whole(_located(text, ACCESS, ("AKIA",)), "access"), _whole(_located(text, HEX), "hex")))


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    def allowed(x: Column) -> Column:
        found = F.lit(False)
        for pattern in allow:
            found = found | x["m"].rlike(pattern)
        return found

    def hits(x: Column) -> Column:
        bound = F.when(x["m"].rlike(HEX_ONLY), F.lit(most(BOUNDS["hex"]))).otherwise(F.lit(most(BOUNDS["wide"])))
        return F.transform(_windows(x["m"], bound), lambda h: _span(x["s"] + h["f"], x["s"] + h["t"], "entropy"))

    kept = F.filter(_located(text, CANDIDATE), lambda x: ~allowed(x))
    return F.flatten(F.transform(kept, hits))


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with two columns more, ``base`` and ``added``: arrays of spans
    (start, rank, end, kind), both sorted by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumns({"base": base_spans(body), "added": F.array_sort(entropy_spans(body))})


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(documents: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, all spans."""
    found = scan(documents.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``documents`` with every span in ``text`` replaced by ``mark`` (overlapping spans by
    one mark) and ``n_chars`` brought up to date. All rows and columns stay; texts without
    a finding, nulls included, are untouched."""
    body = F.col("text")
    spans = F.array_sort(F.concat(base_spans(F.coalesce(body, F.lit(""))), entropy_spans(F.coalesce(body, F.lit("")))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(x: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            overlaps = (s["start"] < state["at"]) & (F.size(state["out"]) > 0)
            piece = F.substring(x["t"], state["at"] + 1, s["start"] - state["at"])
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"),
                F.when(overlaps, state["out"]).otherwise(F.concat(state["out"], F.array(piece, F.lit(mark)))).alias("out"),
            )

        return F.aggregate(
            x["s"], begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(x["t"], s["at"] + 1, F.length(x["t"]) - s["at"]))
        )

    clean = let(F.struct(body.alias("t"), spans.alias("s")), lambda x: F.when(F.size(x["s"]) > 0, cut(x)).otherwise(x["t"]))
    kept = documents.withColumn("text", F.when(body.isNotNull(), clean))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else kept


def oracle() -> str:
    """DuckDB SQL for ``report``: matches by list functions, windows counted anew each time."""
    quoted = {"assign": ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"), "access": ACCESS, "hex": HEX, "cand": CANDIDATE}
    quoted = {k: "'" + v.replace("'", "''") + "'" for k, v in quoted.items()}
    matched = ", ".join(f"regexp_extract_all(t, {v}) AS m_{k}, string_split_regex(t, {v}) AS p_{k}" for k, v in quoted.items())
    located = ", ".join(
        f"list_transform(range(len(m_{k})), lambda i: {{'s': coalesce(list_sum(list_transform(p_{k}[1:i+1], lambda x: length(x))), 0)"
        f" + coalesce(list_sum(list_transform(m_{k}[1:i], lambda x: length(x))), 0), 'm': m_{k}[i+1]}}) AS l_{k}"
        for k in quoted
    )
    rank = {k: i for i, k in enumerate((*KINDS, "entropy"))}
    base = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {rank[k]} AS rank, unnest(l_{k}) AS x FROM located" for k in KINDS)
    costs = "[" + ", ".join(map(str, weights())) + "]"
    allowed = " OR ".join(f"regexp_matches(m, '{x}')" for x in ALLOW)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, {matched} FROM docs),
located AS (SELECT doc_id, {located} FROM cut),
base AS (
  SELECT doc_id, kind, rank, x.s AS s, x.s + length(x.m) AS e FROM ({base})
  WHERE kind <> 'assign' OR length(regexp_extract(x.m, {quoted["assign"]}, 2)) >= {ASSIGN_LEAST}),
candidates AS (SELECT doc_id, x.s AS s, x.m AS m FROM (SELECT doc_id, unnest(l_cand) AS x FROM located)),
windows AS (
  SELECT doc_id, s, m, unnest(range(length(m) - {WINDOW - 1})) AS i FROM candidates WHERE NOT ({allowed})),
hits AS (
  SELECT doc_id, s, i FROM windows
  WHERE list_sum(list_transform(map_values(list_aggregate(string_split(substr(m, i + 1, {WINDOW}), ''), 'histogram')), lambda c: {costs}[(c + 1)::BIGINT]))
     <= CASE WHEN regexp_matches(m, '{HEX_ONLY}') THEN {most(BOUNDS["hex"])} ELSE {most(BOUNDS["wide"])} END),
islands AS (
  SELECT doc_id, s, i, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY i) AS island
  FROM (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) + {WINDOW} THEN 1 ELSE 0 END AS fresh FROM hits)),
added AS (
  SELECT doc_id, 'entropy' AS kind, {rank["entropy"]} AS rank, s + min(i) AS s, s + max(i) + {WINDOW} AS e FROM islands GROUP BY doc_id, s, island),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM added),
lists AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (kind <> 'entropy') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM docs d LEFT JOIN lists USING (doc_id)
"""
