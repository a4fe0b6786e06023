"""SQL functions of the engine, written in SQL and callable from both SQL and Python.

``register`` makes them known to a session; the Python wrappers do so themselves.
A function's arguments are evaluated once however often its body names them.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What a match scores; a fresh start costs the letters skipped before it, MOST_GAP at most.
WHOLE, AT_BOUNDARY, AT_START = 1000, 300, 400
STREAK, STREAK_STEP, FRESH_BOUNDARY, FRESH, MOST_GAP, LENGTH_UNIT = 12, 4, 10, 2, 12, 12
BOUNDARY = r"[ \\t\\n\\r\\x0b\\x0c._-]"
#: Bands of a match, and rank words that a name's head steps over.
EXACT, HEAD, TOKEN, PREFIX, NONE = 0, 1, 2, 3, 4
RANK_WORDS = (
    "family families order orders genus genera class classes phylum phyla kingdom division tribe subfamily superfamily suborder infraorder subgenus subclass superorder section series"
    " group groups clade complex species subspecies taxon taxa"
).split()
#: A letter that no name holds: stands where a form was found.
MARK = "\uE000"


def same_plural(a: str, b: str) -> str:
    """SQL: two words are equal up to a plural s, es or y -> ies; both of three letters or more."""
    plural = lambda x, y: f"{y} = {x} || 's' OR {y} = {x} || 'es' OR (endswith({x}, 'y') AND {y} = left({x}, length({x}) - 1) || 'ies')"
    return f"({a} = {b} OR (length({a}) >= 3 AND length({b}) >= 3 AND ({plural(a, b)} OR {plural(b, a)})))"


_RUN = "STRUCT<a: INT, b: INT>"
#: name, parameters, result, body; each may use those before it.
DEFINED = [
    # Rising places as maximal runs of neighbours: first and last place of each.
    ("runs_of", "p ARRAY<INT>", f"ARRAY<{_RUN}>", "arrays_zip(filter(p, (x, i) -> i = 0 OR get(p, i - 1) <> x - 1), filter(p, (x, i) -> i = size(p) - 1 OR get(p, i + 1) <> x + 1))"),
    ("runs_told", f"r ARRAY<{_RUN}>", "STRING", "array_join(transform(r, x -> concat(x.a - 1, '-', x.b)), ',')"),
    # The first place of each letter after the place of the one before it; 0 where there is none.
    ("places_of", "h STRING, n STRING", "ARRAY<INT>", "aggregate(split(n, ''), CAST(array() AS ARRAY<INT>), (t, c) -> concat(t, array(if(get(t, size(t) - 1) = 0, 0, position(c, h, coalesce(get(t, size(t) - 1), 0) + 1)))))"),
    ("starts_word", "h STRING, at INT", "BOOLEAN", f"at = 1 OR substring(h, at - 1, 1) RLIKE '{BOUNDARY}'"),
    # A run of L letters: what its start is worth, less the gap before it, and L - 1 growing steps.
    ("runs_score", f"h STRING, r ARRAY<{_RUN}>", "DOUBLE",
     f"""aggregate(transform(r, (x, i) -> if(x.a = 1 OR substring(h, x.a - 1, 1) RLIKE '{BOUNDARY}', {FRESH_BOUNDARY}, {FRESH})
      - least(x.a - 1 - if(i = 0, 0, get(r, i - 1).b), {MOST_GAP}) + (x.b - x.a) * {STREAK} + {STREAK_STEP} * (x.b - x.a) * (x.b - x.a + 1) DIV 2), 0L, (t, x) -> t + x) - length(h) DIV {LENGTH_UNIT}"""),
    ("fuzzy_whole", "h STRING, n STRING, at INT", "STRUCT<score: DOUBLE, ranges: STRING>",
     f"named_struct('score', CAST({WHOLE} - (at - 1) + if(starts_word(h, at), {AT_BOUNDARY}, 0) + if(at = 1, {AT_START}, 0) AS DOUBLE), 'ranges', concat(at - 1, '-', at - 1 + length(n)))"),
    ("fuzzy_parts", f"h STRING, r ARRAY<{_RUN}>", "STRUCT<score: DOUBLE, ranges: STRING>", "named_struct('score', runs_score(h, r), 'ranges', runs_told(r))"),
    ("fuzzy_low", "h STRING, n STRING, at INT, p ARRAY<INT>", "STRUCT<score: DOUBLE, ranges: STRING>",
     "CASE WHEN n = '' THEN named_struct('score', 0D, 'ranges', '') WHEN at > 0 THEN fuzzy_whole(h, n, at) WHEN array_contains(p, 0) THEN CAST(NULL AS STRUCT<score: DOUBLE, ranges: STRING>) ELSE fuzzy_parts(h, runs_of(p)) END"),
    ("fuzzy_of", "h STRING, n STRING", "STRUCT<score: DOUBLE, ranges: STRING>", "fuzzy_low(h, n, instr(h, n), places_of(h, n))"),
    # Score and matched ranges of a query in a name; null if its letters don't occur in order.
    ("fuzzy", "name STRING, query STRING", "STRUCT<score: DOUBLE, ranges: STRING>", "fuzzy_of(lower(coalesce(name, '')), lower(coalesce(query, '')))"),
    # A query's words and their regular plurals; words of fewer than three letters stay alone.
    ("forms_of", "query STRING", "ARRAY<STRING>",
     "flatten(transform(filter(split(query, '\\\\s+'), w -> w <> ''), w -> CASE WHEN length(w) < 3 THEN array(w) WHEN endswith(w, 'y') THEN array(w, w || 's', w || 'es', left(w, length(w) - 1) || 'ies') ELSE array(w, w || 's', w || 'es') END))"),
    # The name with each form's places marked, once a form.
    ("marked", "h STRING, forms ARRAY<STRING>", "ARRAY<STRING>", f"transform(forms, f -> replace(h, f, repeat('{MARK}', length(f))))"),
    ("marked_places", "h STRING, m ARRAY<STRING>", "ARRAY<INT>", f"filter(sequence(1, greatest(length(h), 1)), i -> exists(m, x -> substring(x, i, 1) = '{MARK}'))"),
    # Merged ranges where a query's words (or their plurals) stand literally.
    ("lit_low", "h STRING, n STRING", "STRING", "runs_told(runs_of(marked_places(h, marked(h, forms_of(n)))))"),
    ("lit", "name STRING, query STRING", "STRING", "lit_low(lower(coalesce(name, '')), lower(coalesce(query, '')))"),
    # Lower-cased words, outer characters other than letters and digits stripped.
    ("name_words", "s STRING", "ARRAY<STRING>", "regexp_extract_all(lower(s), '[\\\\p{L}\\\\p{N}](?:\\\\S*[\\\\p{L}\\\\p{N}])?', 0)"),
    # The last word that isn't a rank word, or the last word.
    ("head_place", "n ARRAY<STRING>", "INT", f"coalesce(array_max(filter(sequence(1, greatest(size(n), 1)), i -> NOT get(n, i - 1) IN ({', '.join(map(repr, RANK_WORDS))}))), size(n))"),
    ("words_band", "n ARRAY<STRING>, q ARRAY<STRING>, head INT", "INT",
     f"""if(size(n) < size(q), {NONE}, array_min(transform(sequence(size(q), size(n)), e -> CASE
       WHEN NOT startswith(get(n, e - 1), left(get(q, size(q) - 1), 2)) THEN {NONE}
       WHEN NOT forall(sequence(1, size(q)), j -> j = size(q) OR {same_plural("get(n, e - size(q) + j - 1)", "get(q, j - 1)")}) THEN {NONE}
       WHEN {same_plural("get(n, e - 1)", "get(q, size(q) - 1)")} THEN if(e = head, {HEAD}, {TOKEN})
       WHEN startswith(get(n, e - 1), get(q, size(q) - 1)) THEN {PREFIX} ELSE {NONE} END)))"""),
    ("named_band", "n ARRAY<STRING>, q ARRAY<STRING>, same BOOLEAN", "INT", f"CASE WHEN size(q) = 0 OR n IS NULL THEN {NONE} WHEN same THEN {EXACT} ELSE words_band(n, q, head_place(n)) END"),
    # 0 exact, 1 on the head word, 2 on whole words, 3 by a prefix of the last query word, 4 none.
    ("match_band", "name STRING, query STRING", "INT", "named_band(name_words(name), name_words(query), lower(trim(name)) = lower(trim(query)))"),
]


def register(spark: SparkSession) -> None:
    """Make parsers and functions available to SQL."""
    from ..sources import newick, turtle

    newick.register(spark)
    turtle.register(spark)
    for name, parameters, result, body in DEFINED:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.conf.set("treeline.functions", "registered")


def _called(name: str, *given: Column) -> Column:
    spark = SparkSession.getActiveSession()
    if spark.conf.get("treeline.functions", "") != "registered":
        register(spark)
    return F.call_function(name, *given)


def fuzzy(name: Column, query: Column) -> Column:
    """(score, ranges) of a query in a name, null if its letters don't occur in order."""
    return _called("fuzzy", name, query)


def lit(name: Column, query: Column) -> Column:
    """'start-end' pairs of the places to highlight."""
    return _called("lit", name, query)


def match_band(name: Column, query: Column) -> Column:
    """The band of a name for a query, 0 (exact) to 4 (none)."""
    return _called("match_band", name, query)
