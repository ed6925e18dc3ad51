"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans come from four patterns and their checks (octets, Luhn, numbers of digits). Wider patterns and the base matches
that fail their check give further candidates. Labelers vote on every candidate, 1 for, -1 against, 0 abstaining: the
pattern's check, a gazetteer (top-level domains, issuer and dialling prefixes), the words before, the layout of its
separators, and what touches it. Expectation-maximisation over the counts of vote patterns, a table of at most
``4 * 3**5`` rows, estimates each labeler's reliability and each pattern's probability. With these as soft labels a final
span classifier (log-linear in span features) is trained from another small table of counts; what it accepts, unless
it failed a pattern's check or touches a base span, is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.storage import stored

KINDS = ("email", "ip", "card", "phone")
MARK = "\ue000"
ACCEPT = 0.9
RUN = 256

# kind, pattern, what a text must hold. Possessive forms and look-behinds change no match: they keep long runs linear.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", ""),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
)
WIDE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\(\[]at[\)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[\(\[]dot[\)\]]) ?[A-Za-z0-9-]++)++", "at"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9.-])", ""),
)
_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca"
_CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel", "ip": r"\bip\b|host|server|address|login|client",
    "card": "card|visa|credit|payment|karte|carte|tarjeta", "phone": r"phone|tel\b|tel:|call|fax|mobile|telefon",
}


def _found(text: str, kind: str, pattern: str, need: str, base: bool) -> Column:
    """All matches of a text: kind, s, e (code points), m, the 30 characters before, the character after."""
    parts = F.split(F.regexp_replace(F.col(text), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(F.col(text).contains(need) if need else F.col(text).rlike("[0-9]"), parts)


def _running(start: str, values: str, kind: str, merge: str) -> str:
    """SQL: ``start`` merged with the values before each place. Runs of ``RUN`` values are folded by themselves, then their
    results, so that an array of n values copies n * (RUN + n / RUN**2) elements rather than the square of n."""
    fold = lambda xs: f"aggregate({xs}, cast(array({start}) as array<{kind}>), (a, n) -> concat(a, array({merge.format('element_at(a, -1)', 'n')})))"
    inner = f"transform(sequence(0, cast((size(vs) - 1) div {RUN} as int)), i -> {fold(f'slice(vs, i * {RUN} + 1, {RUN})')})"
    bases = fold("transform(runs, r -> element_at(r, -1))")
    whole = f"flatten(zip_with(runs, slice({bases}, 1, size(runs)), (r, b) -> transform(slice(r, 1, size(r) - 1), x -> {merge.format('b', 'x')})))"
    return f"transform(transform(array({values}), vs -> {inner}), runs -> {whole})[0]"


def _spans(parts: str, kind: str, base: bool) -> str:
    """SQL: odd parts are matches; their places come from running lengths."""
    at = _running("0", f"transform({parts}, p -> char_length(p))", "int", "{0} + {1}")
    return f"""if(coalesce(size({parts}), 0) < 2, cast(array() as array<struct<kind:int,s:int,e:int,m:string,before:string,after:string,base:boolean>>),
      transform(filter(transform(zip_with({parts}, {at}, (p, o) -> named_struct('p', p, 'o', o)), (x, i) -> named_struct('i', i, 'p', x.p, 'o', x.o)), x -> x.i % 2 = 1 and x.p is not null),
        x -> named_struct('kind', {KINDS.index(kind)}, 's', x.o, 'e', x.o + char_length(x.p), 'm', x.p,
          'before', right({parts}[x.i - 1], 30), 'after', left({parts}[x.i + 1], 1), 'base', {str(base).lower()})))"""


_LUHN = """aggregate(transform(reverse(split(d, '')), (x, i) -> if(i % 2 = 0, cast(x as int), if(cast(x as int) > 4, cast(x as int) * 2 - 9, cast(x as int) * 2))), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0"""


def _valid(c: str) -> str:
    digits = f"regexp_replace({c}.m, '[^0-9]', '')"
    luhn = _LUHN.replace("split(d, '')", f"split({digits}, '')")
    return f"""case {c}.kind when 0 then true
      when 1 then forall(split({c}.m, '[.]'), p -> char_length(regexp_replace(p, '^0+', '')) <= 3 and cast(right(p, 3) as int) <= 255)
      when 2 then char_length({digits}) between 12 and 19 and {luhn}
      else char_length({digits}) between 9 and 15 end"""


def _votes(c: str) -> str:
    """SQL: kind, span, and a vote of each labeler, from a found span with its check ``ok``."""
    digits = f"regexp_replace({c}.m, '[^0-9]', '')"
    by_kind = lambda values: "case " + " ".join(f"when {c}.kind = {i} then {v}" for i, v in enumerate(values)) + " end"
    yes = lambda test, other=0: f"if({test}, 1, {other})"
    check = f"if({c}.base, if({c}.ok, 1, -1), 0)"
    gazetteer = by_kind((
        yes(f"{c}.m rlike '(?i)(\\\\.|dot[\\\\)\\\\]]) ?({_DOMAINS})$'", -1), yes(f"{c}.m rlike '^(10[.]|192[.]168|172[.]|127[.]|8[.]8|0[.]|255)'"),
        yes(f"{digits} rlike '^(3[4-7]|4|5[1-5]|6[0-5]|2[2-7])'", -1), yes(f"{digits} rlike '^(1[2-9]|3[0-9]|4[0-9])'"),
    ))
    cue = by_kind([yes(f"lower({c}.before) rlike '{_CUES[k].replace(chr(92), chr(92) * 2)}'") for k in KINDS])
    layout = by_kind((
        yes(f"char_length({c}.m) between 6 and 80", -1), yes(f"not {c}.m rlike '(^|[.])0[0-9]'", -1),
        yes(f"{c}.m rlike '^([0-9]{{4}}([ -])[0-9]{{4}}\\\\2[0-9]{{4}}\\\\2[0-9]{{1,7}}|[0-9]{{12,19}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})$'", -1),
        yes(f"{c}.m rlike '^[+]?[0-9]{{0,3}} ?[(]?[0-9]{{2,4}}[)]?[ .-][0-9]{{3,4}}[ .-][0-9]{{3,4}}$'", 0),
    ))
    touch = f"if({c}.before rlike '[0-9A-Za-z$%#_/=.-]$' or {c}.after rlike '^[0-9A-Za-z%_/=]', -1, 1)"
    size = f"least(cast(char_length({c}.m) / 4 as int), 9)"
    marks = f"least(char_length(regexp_replace({c}.m, '[0-9A-Za-z]', '')), 9)"
    return f"named_struct('kind', {c}.kind, 's', {c}.s, 'e', {c}.e, 'base', {c}.base and {c}.ok, 'v1', {check}, 'v2', {gazetteer}, 'v3', {cue}, 'v4', {layout}, 'v5', {touch}, 'size', {size}, 'marks', {marks})"


VOTES = ("v1", "v2", "v3", "v4", "v5")
FEATURES = ("v1", "v2", "v3", "v4", "v5", "size", "marks")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and found: for each text the candidates with their votes. A null text counts as empty."""
    rows = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit("\ufffd")).alias("text"))
    for i, (kind, pattern, need) in enumerate(BASE + WIDE):
        rows = rows.withColumn(f"p{i}", _found("text", kind, pattern, need, i < len(BASE)))
    rows = rows.drop("text")
    for i, (kind, _, _) in enumerate(BASE + WIDE):
        rows = rows.withColumn(f"p{i}", F.expr(_spans(f"p{i}", kind, i < len(BASE))))
    found = rows.select("doc_id", F.expr(f"concat({', '.join(f'p{i}' for i in range(len(BASE + WIDE)))})").alias("found"))
    # numbers that are no card or phone by their length alone are no candidates either
    digits = "char_length(regexp_replace(c.m, '[^0-9]', ''))"
    enough = f"case c.kind when 2 then {digits} between 12 and 19 when 3 then {digits} between 9 and 15 else true end"
    found = found.withColumn("found", F.expr(f"filter(found, c -> {enough})"))
    found = found.withColumn("found", F.expr(f"transform(found, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'm', c.m, 'before', c.before, 'after', c.after, 'base', c.base, 'ok', {_valid('c')}))"))
    return found.withColumn("found", F.expr(f"transform(found, c -> {_votes('c')})"))


def label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern by expectation-maximisation over (pattern, count): one hidden class, labelers
    independent given it, each with its own rates of 1, 0 and -1. It starts from the votes' sum."""
    if not patterns:
        return {}
    p = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in patterns}
    for _ in range(rounds):
        mass = {y: sum(n * (p[v] if y else 1 - p[v]) for v, n in patterns) for y in (0, 1)}
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        rate = {}
        for y in (0, 1):
            for j in range(len(patterns[0][0])):
                for vote in (-1, 0, 1):
                    lean = 1.0 if y == (vote > 0) else 0.5
                    got = sum(n * (p[v] if y else 1 - p[v]) for v, n in patterns if v[j] == vote)
                    rate[y, j, vote] = (got + lean) / (mass[y] + 2.5)
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[1, j, x] / rate[0, j, x]) for j, x in enumerate(v))
            p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return p


def classifier(found: DataFrame) -> dict[tuple[int, str, int], float]:
    """Weights of the span classifier, by kind, feature and value; feature ``bias`` has the prior odds."""
    each = found.select(F.explode("found").alias("c")).select("c.*")
    counted = each.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()  # 4 * 3**5 rows at most
    soft = {}
    for kind in range(len(KINDS)):
        got = label_model(sorted((tuple(r[v] for v in VOTES), r.n) for r in counted if r.kind == kind))
        soft |= {(kind, *v): p for v, p in got.items()}
    if not soft:
        return {}
    labels = each.sparkSession.createDataFrame([(*k, p) for k, p in sorted(soft.items())], f"kind int, {', '.join(f'{v} int' for v in VOTES)}, p double")
    joined = each.join(F.broadcast(labels), ["kind", *VOTES])  # as many rows as vote patterns
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("v")) for f in FEATURES])).alias("x")
    sums = joined.groupBy("kind", *FEATURES).agg(F.sum("p").alias("y1"), F.sum(1 - F.col("p")).alias("y0"))
    sums = sums.select("kind", "y1", "y0", pairs).groupBy("kind", F.col("x.f").alias("f"), F.col("x.v").alias("v")).agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).collect()
    mass = {k: [sum(r[y] for r in sums if r.kind == k and r.f == FEATURES[0]) for y in ("y1", "y0")] for k in range(len(KINDS))}
    weights = {(k, "bias", 0): math.log((m[0] + 1) / (m[1] + 1)) for k, m in mass.items()}
    for r in sums:
        a, b = mass[r.kind]
        # features overlap: each gets a share of its evidence
        weights[r.kind, r.f, r.v] = 0.6 * math.log(((r.y1 + 0.5) / (a + 5)) / ((r.y0 + 0.5) / (b + 5)))
    return weights


def _accepted(weights: dict[tuple[int, str, int], float]) -> str:
    """SQL: does the classifier accept candidate c?"""
    total = []
    for f in ("bias", *FEATURES):
        cases = " ".join(f"when c.kind = {k}{'' if f == 'bias' else f' and c.{f} = {v}'} then {w:.9f}D" for (k, g, v), w in sorted(weights.items()) if g == f)
        total.append(f"coalesce(case {cases} end, 0D)" if cases else "0D")
    return f"{' + '.join(total)} >= {math.log(ACCEPT / (1 - ACCEPT)):.9f}D"


_JOIN = "array_join(transform({0}, c -> concat(element_at(array('email', 'ip', 'card', 'phone'), c.kind + 1), ':', c.s, ':', c.e)), ',')"
_ORDERED = "array_sort({0}, (a, b) -> case when a.s <> b.s then if(a.s < b.s, -1, 1) when a.kind <> b.kind then if(a.kind < b.kind, -1, 1) else if(a.e < b.e, -1, if(a.e > b.e, 1, 0)) end)"


def _apart() -> str:
    """SQL: the spans of ``extra`` that overlap none of ``base``, ordered. In the order of starts, a span overlaps one of
    ``base`` if the largest end before it lies beyond its start, or the least start after it before its end."""
    both = "concat(transform(base, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'b', true)), transform(extra, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'b', false)))"
    before = _running("-1", "transform(xs, c -> if(c.b, c.e, -1))", "int", "greatest({0}, {1})")
    after = _running("2147483647", "reverse(transform(xs, c -> if(c.b, c.s, 2147483647)))", "int", "least({0}, {1})")
    marked = f"zip_with(xs, zip_with({before}, reverse({after}), (x, y) -> named_struct('x', x, 'y', y)), (c, o) -> named_struct('c', c, 'o', o))"
    free = f"filter({marked}, x -> not x.c.b and x.o.x <= x.c.s and x.o.y >= x.c.e)"
    return f"transform(array({_ORDERED.format(both)}), xs -> transform({free}, x -> named_struct('kind', x.c.kind, 's', x.c.s, 'e', x.c.e)))[0]"


# from left to right, the first of overlapping spans; by runs, so that long arrays are not copied for each of their spans
_FIRST = f"""flatten(aggregate(transform(sequence(0, cast((size(extra) - 1) div {RUN} as int)), i -> slice(extra, i * {RUN} + 1, {RUN})),
  named_struct('last', -1, 'runs', cast(array() as array<array<struct<kind:int,s:int,e:int>>>)),
  (acc, xs) -> transform(array(aggregate(xs, named_struct('last', acc.last, 'run', cast(array() as array<struct<kind:int,s:int,e:int>>)),
      (r, c) -> if(r.last > c.s, r, named_struct('last', c.e, 'run', concat(r.run, array(c)))))),
    r -> named_struct('last', r.last, 'runs', concat(acc.runs, array(r.run))))[0]).runs)"""


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of (doc_id, text).

    Counts and base_sha256 are of the base spans alone. spans: base and added spans as kind:start:end (code points, end
    exclusive), by start, then kind. Added spans overlap no other span. A null or empty text has no spans (the digest is that
    of the empty text); repeated rows get equal results; an empty table gives an empty table.
    """
    found = stored(candidates(docs.select("doc_id", "text")), "candidates")
    weights = classifier(found)
    span = "transform(filter(found, c -> {0}), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e))"
    rows = found.select("doc_id", F.expr(span.format("c.base")).alias("base"), F.expr(span.format(f"not c.base and c.v1 >= 0 and {_accepted(weights)}")).alias("extra"))
    rows = rows.withColumn("extra", F.expr(f"if(size(extra) = 0, extra, {_apart()})"))
    rows = rows.withColumn("extra", F.expr(f"if(size(extra) < 2, extra, {_FIRST})"))
    rows = rows.withColumn("base", F.expr(_ORDERED.format("base"))).withColumn("every", F.expr(_ORDERED.format("concat(base, extra)")))
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(F.expr(_JOIN.format("base")), 256).alias("base_sha256"), F.expr(_JOIN.format("every")).alias("spans"), F.size("extra").cast("bigint").alias("n_added"),
    )
