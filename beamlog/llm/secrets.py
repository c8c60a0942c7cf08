"""Secret scan: fixed key shapes, plus sliding-window Shannon entropy of candidate strings. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The key shapes and the order in which kinds are listed.
KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = "(" + KEYWORD + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Equal to matching the open-ended shapes and dropping short matches: a maximal run is found from its start.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64", "entropy_upper")

WINDOW = 20
#: Candidate runs and the least bits a character of a window, by character class.
CLASSES = {"entropy_hex": ("0123456789abcdef", "0-9a-f", 3.0), "entropy_b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "A-Za-z0-9+/_=-", 3.9), "entropy_upper": ("0123456789ABCDEF", "0-9A-F", 3.0)}
#: Candidates that are never reported by entropy: plain words, plain numbers, UUIDs, documentation samples, counted-up alphabets.
ALLOW = ("^[A-Za-z]+$", "^[0-9]+$", "^[A-Z]?[a-z]+([-_/][A-Z]?[a-z]+)*$", "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "EXAMPLE|[Ee]xample|[Pp]laceholder", "abcdefghij|ABCDEFGHIJ|0123456789")
#: c x log2(c) for a count c, in units of 2^-20, so that adding and removing a character leaves no drift.
UNIT = 1 << 20
COUNT_BITS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 2)]


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): code-point start, end and text of the leftmost non-overlapping matches.

    The pieces between matches come from a split by the same pattern; a running sum places the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def place(state: Column, both: Column) -> Column:
        s = state["at"] + F.length(both["g"])
        e = s + F.length(both["m"])
        return F.struct(e.alias("at"), F.array_append(state["out"], F.struct(s.alias("s"), e.alias("e"), both["m"].alias("m"))).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, place, lambda s: s["out"])).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def dense_stretch(candidate: Column, alphabet: str, least: float) -> Column:
    """(first, last): start of the first and end of the last window whose entropy reaches ``least``; -1 where none does.

    One pass with a count per character of the class: the entering and the leaving character change one count
    each, and with it the sum of c x log2(c). Entropy is log2(WINDOW) - sum / WINDOW.
    """
    table = F.array(*[F.lit(v).cast("long") for v in COUNT_BITS])
    most = math.floor((math.log2(WINDOW) - least) * WINDOW * UNIT)
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("c"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    codes = F.transform(F.split(candidate, ""), lambda ch: F.position(ch, F.lit(alphabet)) - 1)

    def step(state: Column, pair: Column) -> Column:
        new, old = pair["n"], pair["o"]
        had = F.get(state["c"], new)
        up = state["sum"] + F.get(table, had + 1) - F.get(table, had)
        added = F.transform(state["c"], lambda v, k: F.when(k == new, v + 1).otherwise(v))
        gone = F.get(added, old)
        total = F.when(old >= 0, up - F.get(table, gone) + F.get(table, gone - 1)).otherwise(up)
        counts = F.when(old >= 0, F.transform(added, lambda v, k: F.when(k == old, v - 1).otherwise(v))).otherwise(added)
        i = state["i"] + 1
        dense = (i >= WINDOW) & (total <= most)
        return F.struct(counts.alias("c"), total.alias("sum"), i.alias("i"),
                        F.when(dense & (state["first"] < 0), i - WINDOW).otherwise(state["first"]).alias("first"), F.when(dense, i).otherwise(state["last"]).alias("last"))

    leaving = F.concat(F.array_repeat(F.lit(-1), WINDOW), codes)
    pairs = F.transform(codes, lambda n, k: F.struct(n.alias("n"), F.get(leaving, k).alias("o")))
    return F.aggregate(pairs, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, kind: str) -> Column:
    """Spans of candidate runs that hold a dense window and match no allow-list entry."""
    alphabet, members, least = CLASSES[kind]
    run = f"(?<![{members}])[{members}]{{{WINDOW},}}"
    clean = F.filter(spans_of(text, run), lambda x: ~F.greatest(*[x["m"].rlike(p) for p in ALLOW]))
    placed = F.transform(clean, lambda x: F.struct(x["s"].alias("s"), dense_stretch(x["m"], alphabet, least).alias("d")))
    dense = F.filter(placed, lambda x: x["d"]["first"] >= 0)
    return F.transform(dense, lambda x: F.struct((x["s"] + x["d"]["first"]).alias("s"), (x["s"] + x["d"]["last"]).alias("e")))


def secret_spans(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` columns and one array column of (s, e) code-point spans per kind of KINDS.

    A null or empty text has no spans. A span is end-exclusive. Rows are independent: nothing is shuffled,
    repeated rows repeat, and extra columns of ``docs`` play no part. Entropy spans come on top of the
    fixed shapes and never replace one.
    """
    t = F.coalesce(F.col("_ss_text"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"_ss_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_ss_text"))
    values = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    strip = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    assign = F.when(t.rlike(ASSIGN), strip(F.transform(F.filter(F.arrays_zip(spans_of(t, ASSIGN).alias("m"), values.alias("v")), lambda x: F.length(x["v"]) >= ASSIGN_LEAST), lambda x: x["m"]))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    return rows.select(
        *[F.col(f"_ss_c{i}").alias(c) for i, c in enumerate(carry)], assign.alias("assign"), strip(spans_of(t, ACCESS)).alias("access"), strip(spans_of(t, HEX)).alias("hex"),
        *[entropy_spans(t, k).alias(k) for k in CLASSES])


def span_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the given span columns, by start and then kind, comma-joined."""
    def told(i: int, k: str) -> Column:
        name = lambda x: F.concat(F.lit(f"{k}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
        return F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("r"), name(x).alias("t")))

    every = F.concat(*[told(i, k) for i, k in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda x: x["t"]), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(KINDS[:3]), 256).alias("base_sha256"), span_text(KINDS).alias("spans"))


def _found_sql(name: str, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    value = f", regexp_extract_all(text, '{p}', {group}) AS {name}_v" if group else ""
    return f"regexp_extract_all(text, '{p}') AS {name}_m, string_split_regex(text, '{p}') AS {name}_g{value}"


def _placed_sql(name: str) -> str:
    return (f"[{{'s': list_sum([length(g) for g in {name}_g[1:i]])::BIGINT + coalesce(list_sum([length(m) for m in {name}_m[1:i-1]]), 0)::BIGINT, "
            f"'n': length({name}_m[i]), 'm': {name}_m[i], 'i': i}} for i in range(1, len({name}_m) + 1)]")


def op9_sql() -> str:
    """From-scratch entropies of every window, instead of running counts."""
    names = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), **{k: (f"[{CLASSES[k][1]}]{{{WINDOW},}}", 0) for k in CLASSES}}
    found = ", ".join(_found_sql(k, *v) for k, v in names.items())
    placed = ", ".join(f"{_placed_sql(k)} AS {k}_p" for k in names)
    allow = " OR ".join("regexp_matches(x.m, '{}')".format(p.replace("'", "''")) for p in ALLOW)
    table = "[" + ", ".join(map(str, COUNT_BITS)) + "]"
    parts = {"assign": f"list_filter(assign_p, lambda x: length(assign_v[x.i]) >= {ASSIGN_LEAST})", "access": "access_p", "hex": "hex_p"}
    kept = ", ".join(f"[{{'s': x.s, 'r': {i}, 't': '{k}:' || x.s || ':' || (x.s + x.n)}} for x in {parts[k]}] AS {k}_s" for i, k in enumerate(KINDS[:3]))
    dense = []
    for i, k in enumerate(KINDS[3:], 3):
        alphabet, _, least = CLASSES[k]
        most = math.floor((math.log2(WINDOW) - least) * WINDOW * UNIT)
        bits = f"list_sum([{table}[length(substring(x.m, j, {WINDOW})) - length(replace(substring(x.m, j, {WINDOW}), c, '')) + 1] for c in string_split('{alphabet}', '')])"
        wins = f"[j for j in range(1, x.n - {WINDOW} + 2) if {bits} <= {most}]"
        dense.append(f"[{{'s': y.s + y.w[1] - 1, 'r': {i}, 't': '{k}:' || (y.s + y.w[1] - 1) || ':' || (y.s + y.w[-1] - 1 + {WINDOW})}} for y in [{{'s': x.s, 'w': {wins}}} for x in {k}_p if NOT ({allow})] if len(y.w) > 0] AS {k}_s")
    join = lambda kinds: "array_to_string([z.t for z in list_sort(" + " || ".join(f"{k}_s" for k in kinds) + ")], ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, {found} FROM d), p AS (SELECT *, {placed} FROM f),
k AS (SELECT *, {kept}, {', '.join(dense)} FROM p)
SELECT doc_id, len(assign_s) AS n_assign, len(access_s) AS n_access, len(hex_s) AS n_hex,
       sha256(coalesce({join(KINDS[:3])}, '')) AS base_sha256, coalesce({join(KINDS)}, '') AS spans
FROM k
"""


OP9_SQL = op9_sql()
