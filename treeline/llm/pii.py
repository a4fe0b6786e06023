"""Personal data by candidate gradient boosting.  [native: DataFrame functions only]

Generators propose spans: the base patterns of each kind, and wider ones
(obfuscated addresses, IPv6, phone numbers without a plus sign, card-like digit
runs that fail the check sum, and key-like runs, which make a fifth kind,
``secret``, that has no base pattern).  Every candidate gets a few binary features
of its format and context, packed into one integer.

The labels come from texts that are made by rule (``made_texts``): personal data in
plain and unusual writing, and look-alikes (numbers with a wrong check digit, part
numbers, commit ids, long names), each in several contexts.  Boosted trees of depth
two learn from one fold of their candidates; the other fold gives each feature code
the share of personal data, shrunk towards the trees' probability.

The thresholds are calibrated on the corpus: candidates of all documents that
overlap no base span are counted by code (at most ``5 * 2**len(FEATURES)`` rows,
whatever the input, which is all that the driver reads), and a kind's threshold is
the lowest score down to which ``PRECISION`` of them are expected to be personal
data.  The trees become one SQL expression.  Candidates that reach their kind's
threshold and overlap no base span are added; base spans always stay.

Defined cases: null text is the empty text without spans; repeated rows get equal
spans; an empty table gives an empty result; other columns pass through, and the
added ones replace ones of the same name.  Patterns are possessive or anchored at
run starts, so very long runs take linear time and no deep recursion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, materialise, read

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with a base pattern and a count column.
COUNTED = KINDS[:4]
PRECISION, PRIOR = 0.9, 4.0
ROUNDS, RATE = 24, 0.5
#: Texts made by rule to learn from.
MADE = 6_000

#: Base patterns in linear form: a run is entered at its start, or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns and what a text must hold before they are tried.
WIDE = {
    "email": (r"[A-Za-z0-9._%+-]{1,64} ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]{1,63}){1,8}", r"[\[({](?:at|AT)[\])}]"),
    "ip": (r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    "phone": (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])00[1-9][ ().0-9-]{7,18}[0-9](?![0-9A-Za-z])", r"[0-9]{3}[ .)-]|00[1-9]"),
    "secret": (r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,40}[0-9])(?=[0-9_+/-]{0,40}[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}", r"[A-Za-z0-9_+/-]{20}"),
}
CONTEXT = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|credit|payment|account|ip|addr|host|server|token|secret|key|passw|auth|bearer|credential)[^0-9A-Za-z]{0,4}(?:[A-Za-z]{1,8}[^0-9A-Za-z]{1,3}){0,2}$"
FEATURES = ("left_alnum", "right_alnum", "separated", "context", "assigned", "usual_size", "usual_head", "varied", "checked", "digits_only")


def _prefix_sums(values: Column) -> Column:
    """Running sums of a bound array, in blocks so that cost grows as n^1.5."""
    b = 64
    zero = F.lit(0)
    add = lambda t, x: t + x
    blocks = F.transform(F.sequence(zero, ((F.size(values) - 1) / b).cast("int")), lambda k: F.aggregate(F.slice(values, k * b + 1, F.lit(b)), zero, add))
    before = lambda bs: F.transform(bs, lambda _, k: F.aggregate(F.slice(bs, F.lit(1), k), zero, add))
    fill = lambda pre: F.transform(values, lambda _, i: F.get(pre, (i / b).cast("int")) + F.aggregate(F.slice(values, (i / b).cast("int") * b + 1, i % b + 1), zero, add))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(bind(blocks, lambda bs: bind(before(bs), fill)))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>>: all matches with their code point offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(v: Column) -> Column:
        sizes = F.zip_with(v, gaps, lambda m, g: F.length(m) + g)
        ends = bind(F.slice(sizes, F.lit(1), F.size(v)), _prefix_sums)
        return F.zip_with(ends, v, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("v")))

    return bind(found, placed)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: bind(F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda t, x: t + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.contains(":") | F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return bind(_digits(v), lambda d: F.length(d).between(12, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _features(kind: str, text: Column, m: Column) -> Column:
    v, s, e = m["v"], m["s"], m["e"]
    from_ = F.greatest(s - 23, F.lit(1))
    left = F.when(s > 0, F.substring(text, from_, s - from_ + 1)).otherwise("")
    right = F.substring(text, e + 1, F.lit(1))
    digits = _digits(v)
    size = {"email": F.length(v) <= 48, "ip": F.length(v).between(7, 39), "card": F.length(digits).isin(15, 16), "phone": F.length(digits).between(10, 12), "secret": F.length(v).between(20, 64)}[kind]
    head = {"email": v.rlike("^[A-Za-z]"), "ip": v.rlike("^[1-9A-Fa-f]"), "card": v.rlike("^[3-6]"), "phone": v.rlike(r"^(?:\+[1-9]|\()"), "secret": v.rlike("^(?:[0-9a-f]+|[A-Z0-9]+|[A-Za-z0-9+/]+={0,2})$")}[kind]
    flags = [
        left.rlike("[0-9A-Za-z]$"), right.rlike("^[0-9A-Za-z]"), v.rlike("[^0-9A-Za-z@.+]"), left.rlike(CONTEXT),
        left.rlike("[=\"'] ?$"), size, head, F.size(F.array_distinct(F.split(digits, ""))) >= 4,
        _valid(kind, v), v.rlike("^[0-9]+$"),
    ]
    total = F.lit(0)
    for i, f in enumerate(flags):
        total = total + F.when(f, 1 << i).otherwise(0)
    return total


def _made(kind: str, number: int, text: Column, m: Column, base: Column) -> Column:
    return F.struct(m["s"].alias("s"), F.lit(number).alias("kind"), m["e"].alias("e"), base.alias("base"), _features(kind, text, m).alias("bits"))


def _of_base(kind: str, number: int, text: Column) -> Column:
    """Valid matches of the base pattern, and card-like runs that fail the check sum."""
    found = F.transform(_matches(text, BASE[kind]), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v"), _valid(kind, m["v"]).alias("ok")))
    wanted = F.filter(found, lambda m: m["ok"] | F.length(_digits(m["v"])).between(13, 16) if kind == "card" else m["ok"])
    return F.transform(wanted, lambda m: _made(kind, number, text, m, m["ok"]))


def _of_wide(kind: str, number: int, text: Column, pattern: str) -> Column:
    return F.transform(_matches(text, pattern), lambda m: _made(kind, number, text, m, F.lit(False)))


def _candidates(text: Column) -> Column:
    """array<struct<s, kind, e, base, bits>> of all generators."""
    digit = text.rlike("[0-9]")
    gate = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    item = "array<struct<s:int,kind:int,e:int,base:boolean,bits:int>>"
    groups = []
    for number, kind in enumerate(KINDS):
        if kind in BASE:
            groups.append(F.when(gate[kind], _of_base(kind, number, text)).otherwise(F.array().cast(item)))
        if kind in WIDE:
            pattern, hint = WIDE[kind]
            groups.append(F.when((digit if kind != "email" else F.lit(True)) & text.rlike(hint), _of_wide(kind, number, text, pattern)).otherwise(F.array().cast(item)))
    return F.concat(*[g.cast(item) for g in groups])


# ------------------------------------------------------------------ boosting


class Trees:
    """Boosted depth-two trees over binary features, fitted on counts."""

    def __init__(self, rows: list[tuple[int, int, float]]):
        """rows: (code, label, weight); bit i of code is feature i."""
        self.bits = len(FEATURES) + 2
        self.trees: list[tuple[int, tuple[int, int], tuple[float, float, float, float]]] = []
        total = sum(w for _, _, w in rows)
        positive = sum(w for _, y, w in rows if y)
        self.start = math.log((positive + 1) / (total - positive + 1))
        score = [self.start] * len(rows)
        for _ in range(ROUNDS if rows else 0):
            grad = [((1 / (1 + math.exp(-s))) - y, w) for s, (_, y, w) in zip(score, rows, strict=True)]
            stats = [(c, g * w, max(1e-6, (g + y) * (1 - g - y)) * w) for (c, y, _), (g, w) in zip(rows, grad, strict=True)]
            root, leaves = self._grow(stats)
            self.trees.append((root, *leaves))
            score = [s + self._leaf(self.trees[-1], c) for s, (c, _, _) in zip(score, rows, strict=True)]

    def _split(self, stats: list) -> tuple[float, int]:
        best = (-1.0, 0)
        for f in range(self.bits):
            gain = 0.0
            for side in (0, 1):
                g = sum(x for c, x, _ in stats if (c >> f) & 1 == side)
                h = sum(x for c, _, x in stats if (c >> f) & 1 == side)
                gain += g * g / (h + 1)
            best = max(best, (gain, -f))
        return best[0], -best[1]

    def _grow(self, stats: list) -> tuple[int, tuple]:
        root = self._split(stats)[1]
        second, values = [], []
        for side in (0, 1):
            part = [x for x in stats if (x[0] >> root) & 1 == side]
            f = self._split(part)[1]
            second.append(f)
            for under in (0, 1):
                own = [x for x in part if (x[0] >> f) & 1 == under]
                values.append(-RATE * sum(g for _, g, _ in own) / (sum(h for _, _, h in own) + 1))
        return root, (tuple(second), tuple(values))

    @staticmethod
    def _leaf(tree: tuple, code: int) -> float:
        root, second, values = tree
        a = (code >> root) & 1
        return values[2 * a + ((code >> second[a]) & 1)]

    def score(self, code: int) -> float:
        return self.start + sum(self._leaf(t, code) for t in self.trees)

    def column(self, code: Column) -> Column:
        """The same sum as an expression over an integer column."""
        bit = lambda f: code.bitwiseAND(F.lit(1 << f)) != 0
        total = F.lit(self.start)
        for root, second, v in self.trees:
            total = total + F.when(bit(root), F.when(bit(second[1]), v[3]).otherwise(v[2])).otherwise(F.when(bit(second[0]), v[1]).otherwise(v[0]))
        return total


def _code(kind: Column, bits: Column) -> Column:
    return bits + kind * F.lit(1 << len(FEATURES))


def made_texts(spark: SparkSession, n: int = MADE) -> DataFrame:
    """(id, text, kind, s, e, good): texts made by rule, each with one piece at
    [s, e) that is personal data of its kind (good) or only looks like it."""
    d = lambda k, size: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**size)).cast("string"), size, "0")
    x = lambda k, size: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")).cast("binary"), 256), 1, size)
    w = lambda k, size: F.translate(x(k, size), "0123456789", "ghijklmnop")
    octet = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(255)) + 1).cast("string")

    def card(k: int, good: bool) -> Column:
        last = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("4"), d(k, 14), i.cast("string"))), lambda v: _luhn(v) if good else ~_luhn(v)), F.lit(0))
        return last if k % 2 else F.regexp_replace(last, "(.{4})(?=.)", "$1 ")

    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    email, ip, card_, phone, secret = range(5)
    neutral, named, assigned = "the rest of ", "", ""
    names = {email: "write to mail ", ip: "on the server ", card_: "my credit card ", phone: "please call ", secret: 'token = "'}
    #: kind, good, piece, contexts (neutral, named, assigned) in which it stands
    forms = [
        (email, True, join(w(1, 6), ".", d(2, 2), "@", w(3, 6), ".example.com"), "nna"),
        (email, True, join(w(1, 6), " [at] ", w(3, 6), " [dot] com"), "nm"),
        (email, True, join(w(1, 6), "(at)", w(3, 6), ".org"), "nm"),
        (ip, True, F.concat_ws(".", *[octet(k) for k in range(4)]), "nma"),
        (ip, True, F.concat_ws(":", *[x(k, 4) for k in range(8)]), "nma"),
        (ip, False, F.concat_ws(":", *[d(k, 1) for k in range(8)]), "n"),
        (card_, True, card(1, True), "nma"),
        (card_, True, card(2, True), "nm"),
        (card_, False, card(3, False), "nnm"),
        (card_, False, card(4, False), "n"),
        (phone, True, join("+1 (", d(1, 3), ") 555-", d(2, 4)), "nma"),
        (phone, True, join("(", d(1, 3), ") 555-", d(2, 4)), "nm"),
        (phone, True, join(d(1, 3), "-555-", d(2, 4)), "m"),
        (phone, True, join("0049 ", d(1, 3), " ", d(2, 7)), "nm"),
        (phone, False, join(d(1, 3), " ", d(2, 3), " ", d(3, 4)), "n"),
        (phone, False, join("00", d(1, 14)), "nnm"),
        (phone, False, join("001", d(1, 8), "-", d(2, 5)), "n"),
        (secret, True, x(1, 40), "mmma"),
        (secret, True, join("AKIA", F.upper(w(1, 8)), d(2, 8)), "mma"),
        (secret, True, join(F.substring(F.base64(F.unhex(x(1, 48))), 1, 32)), "mma"),
        (secret, False, x(1, 40), "n"),
        (secret, False, join(w(1, 8), "_", w(2, 7), "_", d(3, 2), "_", w(4, 8)), "nnma"),
        (secret, False, join(w(1, 9), "-", w(2, 9), "-", d(3, 1)), "nn"),
        (secret, False, join(x(1, 8), "-", x(2, 4), "-", x(3, 4), "-", x(4, 12)), "nn"),
    ]
    left = {"n": lambda k: neutral, "m": lambda k: names[k], "a": lambda k: 'api_key = "' if k == secret else 'field="'}
    made = [(k, good, join(w(90, 5), " ", left[c](k)), piece) for k, good, piece, where in forms for c in where]
    shown = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(good).alias("good"), a.alias("a"), p.alias("p")) for k, good, a, p in made])
    rows = spark.range(n).select("id", F.get(shown, F.pmod("id", F.lit(len(made))).cast("int")).alias("x"))
    begin = F.length("x.a")
    tail = F.when(F.col("x.a").endswith('"'), '" ').otherwise(F.element_at(F.array(F.lit(" "), F.lit(". "), F.lit(", ")), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int")))
    return rows.select("id", F.concat("x.a", "x.p", tail, w(91, 7)).alias("text"), "x.kind", begin.alias("s"), (begin + F.length("x.p")).alias("e"), "x.good")


def examples(spark: SparkSession) -> list[tuple[int, int, int, float]]:
    """(fold, code, label, n): candidates within the pieces of the made texts; of a
    good piece, candidates of its kind over at least four fifths of it are right and
    others of its kind are left out."""
    made = made_texts(spark)
    c = made.select("id", "kind", "s", "e", "good", F.explode(bind(F.col("text"), _candidates)).alias("c")).where((F.col("c.s") < F.col("e")) & (F.col("s") < F.col("c.e")) & (F.col("c.kind") == F.col("kind")))
    most = (F.least("c.e", "e") - F.greatest("c.s", "s")) * 5 >= (F.col("e") - F.col("s")) * 4
    told = c.where(~F.col("good") | most)
    counts = told.groupBy(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).alias("fold"), _code(F.col("c.kind"), F.col("c.bits")).alias("code"), F.col("good").cast("int").alias("y")).agg(F.count("*").alias("n"))
    return sorted((int(r["fold"]), r["code"], r["y"], float(r["n"])) for r in counts.collect())


def _clear_of_base(candidates: Column) -> Column:
    """Wider candidates that overlap no base span."""
    base = F.filter(candidates, lambda x: x["base"])
    wide = lambda b: F.filter(candidates, lambda x: ~x["base"] & ~F.exists(b, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    return F.when(F.exists(candidates, lambda x: ~x["base"]), bind(base, wide)).otherwise(F.slice(candidates, F.lit(1), F.lit(0)))


def learn(found: DataFrame) -> tuple[Trees, list[float]]:
    """Trees from the made texts, and each kind's threshold from the counts of all
    candidates of the corpus that may be added."""
    rows = examples(found.sparkSession)
    trees = Trees([r[1:] for r in rows if r[0] == 0])
    seen: dict[int, list[float]] = {}
    for fold, code, y, n in rows:
        if fold == 1:
            seen.setdefault(code, [0.0, 0.0])[y] += n

    def chance(code: int) -> float:
        bad, good = seen.get(code, (0.0, 0.0))
        return (good + PRIOR / (1 + math.exp(-trees.score(code)))) / (good + bad + PRIOR)

    free = found.select(F.explode(_clear_of_base(F.col("candidates"))).alias("c"))
    counts = free.groupBy(_code(F.col("c.kind"), F.col("c.bits")).alias("code")).agg(F.count("*").alias("n")).collect()
    return trees, [_threshold([(trees.score(r["code"]), chance(r["code"]), r["n"]) for r in counts if r["code"] >> len(FEATURES) == k]) for k in range(len(KINDS))]


def _threshold(rows: list[tuple[float, float, int]]) -> float:
    """rows (score, chance of personal data, count) -> the lowest score down to
    which PRECISION of the candidates are expected to be right; infinite if none."""
    limit, good, seen = math.inf, 0.0, 0
    scored = sorted(rows, key=lambda r: -r[0])
    for i, (score, chance, n) in enumerate(scored):
        good, seen = good + chance * n, seen + n
        if (i + 1 == len(scored) or scored[i + 1][0] < score) and good >= PRECISION * seen:
            limit = score
    return limit


def detect(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Candidates of every document, with the carried columns (default: all) in ``row``."""
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED]
    return docs.select((F.struct(*kept) if kept else F.lit(None)).alias("row"), bind(body, _candidates).alias("candidates"))


ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redactions")


def _is(number: int):
    return lambda x: x["kind"] == number


def select(found: DataFrame, model: tuple[Trees, list[float]]) -> DataFrame:
    """Choose redactions among candidates: base ones and those whose boosted score
    reaches the calibrated threshold."""
    trees, limits = model

    def chosen(x: Column) -> Column:
        ok = F.lit(False)
        for number, limit in enumerate(limits):
            if limit < math.inf:
                ok = ok | ((x["kind"] == number) & (trees.column(_code(x["kind"], x["bits"])) >= F.lit(limit - 1e-9)))
        return ok

    apart = lambda x, y: (x["e"] <= y["s"]) | (y["e"] <= x["s"])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    def picked(c: Column) -> Column:
        """(base, redactions) of a bound array of candidates."""
        extra = F.array_sort(F.filter(_clear_of_base(c), chosen))
        empty = F.slice(c, F.lit(1), F.lit(0))
        clear = bind(extra, lambda x: F.aggregate(x, empty, lambda t, y: F.when(F.exists(t, lambda z: ~apart(z, y)), t).otherwise(F.concat(t, F.array(y)))))
        base = F.array_sort(F.filter(c, lambda x: x["base"]))
        return F.struct(base.alias("base"), F.array_sort(F.concat(F.filter(c, lambda x: x["base"]), F.when(F.exists(c, lambda x: ~x["base"]), clear).otherwise(empty))).alias("redactions"))

    def figures(b: Column) -> Column:
        counts = [F.size(F.filter(b["base"], _is(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(COUNTED)]
        return F.struct(*counts, F.sha2(told(b["base"]), 256).alias("base_sha256"), told(b["redactions"]).alias("spans"), b["redactions"].alias("redactions"))

    made = found.select("row", bind(F.col("candidates"), lambda c: bind(picked(c), figures)).alias("made"))
    return made.select("row.*", "made.*")


def pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every document with its counts, spans and chosen ``redactions``.

    Candidates are found twice, once to be counted and once to be chosen from, so
    that no copy of the documents is stored."""
    return select(detect(docs, text), learn(detect(docs, text, carry=[])))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace the redactions in ``text`` by their kind in brackets; where spans
    overlap, the later one starts at the earlier one's end."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,kind:int>>").alias("cut"))

    def push(t: Column, x: Column) -> Column:
        piece = F.struct(F.greatest(x["s"], t["at"]).alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
        return F.when(x["e"] <= t["at"], t).otherwise(F.struct(x["e"].alias("at"), F.concat(t["cut"], F.array(piece)).alias("cut")))

    cuts = F.aggregate("redactions", start, push, lambda t: t["cut"])

    def rebuilt(c: Column) -> Column:
        before = lambda x, i: bind(F.when(i > 0, F.get(c, i - 1)["e"]).otherwise(0), lambda p: F.substring(F.col(text), p + 1, x["s"] - p))
        parts = F.transform(c, lambda x, i: F.concat(before(x, i), F.get(tags, x["kind"])))
        return F.concat(F.array_join(parts, ""), F.substring(F.col(text), F.get(c, F.size(c) - 1)["e"] + 1, F.length(text)))

    return found.withColumn(text, F.when(F.size("redactions") == 0, F.col(text)).otherwise(bind(cuts, rebuilt))).drop(*ADDED)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialise(detect(docs, carry=["doc_id"]))  # ids and candidates only
    return select(found, learn(found)).drop("redactions")
