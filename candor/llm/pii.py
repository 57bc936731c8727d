"""Personal data: candidate spans scored by gradient-boosted trees, in DataFrame functions only.

`find(docs)` is a map over the documents: no shuffle, no Python. Base spans come from four fixed patterns with
checks of their values and always stay. High-recall generators propose further, overlapping spans: what the base
patterns matched but its checks refused, mail addresses with "at" and "dot" written out, addresses of hosts with
guarded dots, cards and telephone numbers in other groupings, and long random-looking strings (kind secret, which has
no base pattern). Boosted trees over format and context features score them; those at or above their kind's calibrated
threshold that meet no base span are added, of overlapping ones the one with the higher score.

No label says which spans are personal, so the trees learn from base spans made unlike themselves (`examples`): every
base span of every document, in its own surroundings, is rewritten in a form that the base patterns cannot see (its
cues removed: a written-out @, no +, guarded or moved dots) and is a positive; beside it stands a hard negative of the
same look (broken check digits, numbers past 255, dates, prices, versions, order numbers, plain words). A fixed number
of made-up seeds, from 600 numbers, is added, so that a kind that the documents lack is learned too. The examples are
counted per combination of features over all documents; a fifth is held out, and a kind's threshold is the lowest score
from which on held-out candidates are positive with at least `precision`. The fitted trees become one SQL expression.

Null text counts as empty: no spans. Rows with equal ids are kept apart. Other columns are ignored. An empty table has
no rows; the trees then rest on the made-up seeds.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# Equal in their matches to the contract's patterns; possessive repeats and look-behinds only save the engine
# retries inside one run of characters, so that a long run costs time in proportion to its length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

_AT = r"(?: ?[\[({<] ?(?:at|AT|At) ?[\])}>] ?| (?:at|AT) )"
_DOT = r"(?: ?[\[({<] ?(?:dot|DOT|Dot|\.) ?[\])}>] ?| (?:dot|DOT) |\.)"

# Generators of further candidates, by the kind they propose.
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++)*+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[(](?:\.|dot|DOT)[\])] ?| dot )[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ ./_:-]{1,3}[0-9]{4}[ ./_:-]{1,3}[0-9]{4}[ ./_:-]{1,3}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9.+(-])(?:\([0-9]{2,5}\) ?|00[1-9][ ().-]{0,2})?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,5}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}

FEATURES = ("digits", "chars", "plus", "parens", "dots", "dashes", "blanks", "guards", "spelled", "letters", "distinct", "hex", "valid", "before", "after", "context")
_WORDS = {
    "email": "mail|contact|write|address|reach",
    "ip": "host|server|addr|login|from",
    "card": "card|visa|pay|account|master",
    "phone": "phone|call|tel|mobile|fax|reach|dial",
    "secret": "token|secret|passw|key|auth|cred",
}


def _spans(text: str, found: str, pattern: str) -> Column:
    """Column `found` (all matches of `pattern`) to array<struct<s,e,v>>, ends exclusive, in code points."""
    literal = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"""case when size({found}) = 0 then cast(array() as array<struct<s:bigint,e:bigint,v:string>>) else
        aggregate(sequence(0, size({found}) - 1),
          named_struct('at', 0L, 'cut', split({text}, '{literal}', -1), 'out', cast(array() as array<struct<s:bigint,e:bigint,v:string>>)),
          (x, i) -> named_struct('at', x.at + length(x.cut[i]) + length({found}[i]), 'cut', x.cut,
             'out', concat(x.out, array(named_struct('s', x.at + length(x.cut[i]), 'e', x.at + length(x.cut[i]) + length({found}[i]), 'v', {found}[i])))),
          x -> x.out) end"""
    )


_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CHECKS = {
    "email": "true",
    "ip": rf"x.v rlike '^{_PART}[.]{_PART}[.]{_PART}[.]{_PART}$'",
    "card": """length(translate(x.v, ' -', '')) between 16 and 19 and
        aggregate(sequence(1, length(translate(x.v, ' -', ''))), 0L, (t, i) -> t +
          case when i % 2 = 1 then cast(substr(reverse(translate(x.v, ' -', '')), i, 1) as int)
               else (2 * cast(substr(reverse(translate(x.v, ' -', '')), i, 1) as int)) div 10 + (2 * cast(substr(reverse(translate(x.v, ' -', '')), i, 1) as int)) % 10 end) % 10 = 0""",
    "phone": "length(translate(x.v, '+ ().-', '')) between 8 and 15",
}



def _char_class(at: str) -> str:
    return f"case when {at} = '' then 0 when {at} rlike '^\\\\s$' then 1 when {at} rlike '^[0-9]$' then 2 when {at} rlike '^[A-Za-z]$' then 3 else 4 end"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0L, (t, i) -> t + case when i % 2 = 1 then cast(substr(reverse({_DIGITS}), i, 1) as int)
    else (2 * cast(substr(reverse({_DIGITS}), i, 1) as int)) div 10 + (2 * cast(substr(reverse({_DIGITS}), i, 1) as int)) % 10 end) % 10 = 0"""
# Whether what a candidate says could be of its kind, whatever its form.
_VALID = {
    "email": "x.v rlike '[A-Za-z][A-Za-z0-9-]*[^A-Za-z0-9]+[A-Za-z]{2,}$'",
    "ip": "size(regexp_extract_all(x.v, '[0-9]+', 0)) = 4 and forall(regexp_extract_all(x.v, '[0-9]+', 0), y -> length(y) <= 3 and cast(y as int) <= 255)",
    "card": f"length({_DIGITS}) between 16 and 19 and ({_LUHN})",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "secret": "x.v rlike '[0-9]' and x.v rlike '[A-Za-z]'",
}


def _features(kind: str) -> dict[str, str]:
    """SQL of each feature of a candidate `x` (s, e, v) of a kind within `body`, the text."""
    count = lambda chars: f"length(x.v) - length(translate(x.v, '{chars}', ''))"
    return {
        "digits": f"least(24, {count('0123456789')})",
        "chars": "least(12, length(x.v) div 4)",
        "plus": "case when x.v like '+%' then 1 else 0 end",
        "parens": f"least(2, {count('()')})",
        "dots": f"least(4, {count('.')})",
        "dashes": f"least(4, {count('-')})",
        "blanks": f"least(4, {count(' ')})",
        "guards": f"least(4, {count('[]{}<>')})",
        "spelled": "least(4, size(regexp_extract_all(x.v, '(?i)(?<![A-Za-z])(?:at|dot)(?![A-Za-z])', 0)))",
        "letters": "least(6, (length(x.v) - length(regexp_replace(x.v, '[A-Za-z]', ''))) div 2)",
        "distinct": "least(10, size(array_distinct(split(lower(left(x.v, 64)), ''))) div 2)",
        "hex": "case when x.v rlike '^[0-9a-fA-F]+$' then 1 else 0 end",
        "valid": f"case when {_VALID[kind]} then 1 else 0 end",
        "before": _char_class("substr(body, cast(greatest(x.s, 1) as int), cast(least(x.s, 1) as int))"),
        "after": _char_class("substr(body, cast(x.e + 1 as int), 1)"),
        "context": f"case when lower(substr(body, cast(greatest(x.s - 23, 1) as int), cast(least(x.s, 24) as int))) rlike '{_WORDS[kind]}' then 1 else 0 end",
    }


def _matches(pattern: str) -> Column:
    return F.regexp_extract_all("body", F.lit(pattern), F.lit(0))


def base_spans(texts: DataFrame) -> DataFrame:
    """The columns of `texts` (with body), base_<kind>, and bare_<kind>: the matches of the base patterns that fail its checks."""
    has = {"email": F.col("body").contains("@"), "phone": F.col("body").contains("+")}
    raw = texts.select("*", *(F.when(has.get(k, F.lit(True)), _matches(p)).otherwise(F.array().cast("array<string>")).alias(f"m_{k}") for k, p in PATTERNS.items()))
    placed = raw.select(*texts.columns, *(_spans("body", f"m_{k}", p).alias(f"all_{k}") for k, p in PATTERNS.items()))
    return placed.select(*texts.columns, *(F.expr(f"filter(all_{k}, x -> {_CHECKS[k]})").alias(f"base_{k}") for k in KINDS), *(F.expr(f"filter(all_{k}, x -> not ({_CHECKS[k]}) and length(x.v) between 7 and 40)").alias(f"bare_{k}") for k in KINDS))


def candidates(based: DataFrame) -> DataFrame:
    """The columns of `based` but bare_<kind>, and cand_<kind>: what the generators and the refused matches propose."""
    keep = [c for c in based.columns if not c.startswith("bare_")]
    found = based.select(*based.columns, *(_matches(p).alias(f"g_{k}") for k, p in GENERATORS.items()))
    placed = {k: _spans("body", f"g_{k}", p) for k, p in GENERATORS.items()}
    return found.select(*keep, *((F.concat(f"bare_{k}", placed[k]) if k in KINDS else placed[k]).alias(f"cand_{k}") for k in ALL_KINDS))


def _digits_of(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _groups(digits: str, sizes: tuple[int, ...], joins: tuple[str, ...]) -> str:
    at, parts = 1, []
    for size, join in zip(sizes, (*joins, ""), strict=True):
        parts += [f"substr({digits}, {at}, {size})", f"'{join}'"]
        at += size
    return f"concat({', '.join(parts)})"


_CARD, _PHONE = "left(rpad(regexp_replace(v, '[^0-9]', ''), 16, '0'), 16)", "right(lpad(regexp_replace(v, '[^0-9]', ''), 10, '7'), 10)"
_BROKEN = f"concat(left({_CARD}, 15), cast((cast(right({_CARD}, 1) as int) + 3) % 10 as string))"
# Forms in which a base value `v` of a kind is still what it was, though no base pattern sees it; `h` is a number of the seed.
HIDDEN = {
    "email": [
        "replace(v, '@', ' [at] ')",
        "replace(replace(v, '@', ' (at) '), '.', ' (dot) ')",
        "replace(replace(v, '@', '[at]'), '.', '[dot]')",
        "replace(replace(v, '@', ' at '), '.', ' dot ')",
        "replace(replace(v, '@', ' AT '), '.', ' DOT ')",
        "replace(v, '@', '{at}')",
    ],
    "ip": ["replace(v, '.', '[.]')", "replace(v, '.', '(.)')", "replace(v, '.', '[dot]')", "replace(v, '.', ' dot ')", "replace(v, '.', ' [.] ')"],
    "card": [_groups(_CARD, (4, 4, 4, 4), (x, x, x)) for x in (".", "/", "_", " - ", ":")],
    "phone": [
        f"concat('(', left({_PHONE}, 3), ') ', substr({_PHONE}, 4, 3), '-', right({_PHONE}, 4))",
        _groups(_PHONE, (3, 3, 4), ("-", "-")),
        _groups(_PHONE, (3, 3, 4), (".", ".")),
        _groups(_PHONE, (3, 3, 4), (" ", " ")),
        f"concat('001 ', {_groups(_PHONE, (3, 3, 4), (' ', ' '))})",
        f"concat('0049 ', {_groups(_PHONE, (2, 4, 4), (' ', ' '))})",
    ],
    "secret": ["sha1(v)", "substr(base64(unhex(sha2(v, 256))), 1, 40)", "concat('sk-', left(sha2(v, 256), 32))", "upper(sha1(v))", "md5(v)"],
}
# Text of the same look that is nothing of the kind.
HARD = {
    "email": ["'look (at) this'", "'be at home. now'", "concat('sold at ', h % 90, '.', h % 10)", "'met at noon.Then'", "'stay [at] the.end of it'", "concat('open at ', h % 12, '.30 daily')"],
    "ip": ["concat('3', h % 90 + 10, '[.]', 256 + h % 300, '[.]1[.]999')", "concat(h % 900 + 100, ' dot 700 dot 1 dot 2')", "concat(h % 300 + 300, '(.)400(.)500(.)600')", "concat('1.', h % 20, '.', h % 7, '.4.5.6')"],
    "card": [
        *(_groups(_BROKEN, (4, 4, 4, 4), (x, x, x)) for x in (".", "/", "_", " - ", ":")),
        _BROKEN,
    ],
    "phone": [
        "concat(2000 + h % 25, '-', lpad(h % 12 + 1, 2, '0'), '-', lpad(h % 28 + 1, 2, '0'))",
        "concat(lpad(h % 28 + 1, 2, '0'), '.', lpad(h % 12 + 1, 2, '0'), '.', 1990 + h % 35)",
        "concat(2000 + h % 25, '-', lpad(h % 12 + 1, 2, '0'), '-', lpad(h % 28 + 1, 2, '0'), ' ', lpad(h % 24, 2, '0'))",
        "concat(1900 + h % 100, '-', 2000 + h % 25)",
        "concat(h % 90 + 10, '.', h % 90 + 10)",
        "concat('978-', h % 10, '-', lpad(h % 97, 2, '0'), '-', lpad(h % 999983, 6, '0'), '-', h % 10)",
        "concat(h % 90 + 10, ' ', h % 900 + 100)",
        "concat(h % 900 + 100, ' ', h % 900 + 100, '.', h % 90 + 10)",
    ],
    "secret": ["repeat('ab', 14)", "concat('unchangeablenesses', substr('abcdefghijklmnopqrstuvwxyz', 1 + h % 9, 8))", "concat('docs/guide/chapter-', h % 40, '/section')", "repeat('-', 30 + h % 30)", "lpad(h, 24, '0')", "repeat('=_', 20)", "concat('Donaudampfschifffahrts', repeat('e', h % 5), 'gesellschaft')"],
}


def examples(docs: DataFrame, made_up: int = 600) -> DataFrame:
    """One row per example: body, the place (s0, e0) of the example in it, its kind, and label (1.0: hidden, 0.0: hard negative).

    Each base span of `docs` gives a hidden form, a hard negative and a made-up secret, in its own surroundings; so does
    each of `made_up` numbers, in plain ones.
    """
    based = base_spans(docs.select(text_or_empty().alias("body")))
    every = F.expr("concat(" + ", ".join(f"transform(base_{k}, x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e, 'v', x.v))" for k in KINDS) + ")")
    found = based.select("body", F.explode(every).alias("x")).where("length(x.v) <= 80")
    real = found.selectExpr("x.kind", "x.v", "substr(body, cast(greatest(x.s - 23, 1) as int), cast(least(x.s, 24) as int)) as lead", "substr(body, cast(x.e + 1 as int), 8) as tail")
    h = "pmod(xxhash64(id, 5), 100000000)"
    fifteen = f"lpad({h} * 7919 % 1000000000000000, 15, '4')"
    luhn = f"aggregate(sequence(1, 15), 0L, (t, i) -> t + case when i % 2 = 0 then cast(substr({fifteen}, i, 1) as int) else (2 * cast(substr({fifteen}, i, 1) as int)) div 10 + (2 * cast(substr({fifteen}, i, 1) as int)) % 10 end)"
    names, hosts = "array('ann', 'bo.lee', 'kim_77', 'j-doe', 'info', 'max.9', 'sales.team', 'x12')", "array('corp', 'mail3.example', 'uni.example', 'post', 'my-shop.example')"
    own = f"""case id % 4 when 0 then concat(element_at({names}, cast({h} % 8 + 1 as int)), '@', element_at({hosts}, cast({h} div 8 % 5 + 1 as int)), '.', element_at(array('com', 'org', 'net', 'de'), cast({h} div 40 % 4 + 1 as int)))
        when 1 then concat({h} % 256, '.', {h} div 7 % 256, '.', {h} div 31 % 256, '.', {h} div 77 % 256)
        when 2 then concat({fifteen}, (10 - ({luhn}) % 10) % 10) else concat('+1 (', lpad({h} % 900 + 100, 3, '0'), ') 555-', lpad({h} % 10000, 4, '0')) end"""
    lead = "element_at(array('and then ', '', 'the call went to ', 'card ', 'mail: ', 'token = \"', 'phone ', 'key: '), cast(id div 4 % 8 + 1 as int))"
    tail = "element_at(array('', ' and', '. So', ', the', '\"'), cast(id div 3 % 5 + 1 as int))"
    invented = docs.sparkSession.range(made_up).selectExpr("element_at(array('email', 'ip', 'card', 'phone'), cast(id % 4 + 1 as int)) as kind", f"{own} as v", f"{lead} as lead", f"{tail} as tail")
    seeds = written(real.unionByName(invented)).withColumn("h", F.expr("pmod(xxhash64(kind, v, lead), 1000003)"))
    made = []
    for kind in ALL_KINDS:
        own = f"kind = '{kind}'" if kind in KINDS else "true"
        own += " and length(regexp_replace(v, '[^0-9]', '')) = 16" if kind == "card" else ""
        for label, forms in ((1.0, HIDDEN[kind]), (0.0, HARD[kind])):
            form = " ".join(f"when {i} then {f}" for i, f in enumerate(forms))
            made.append(f"case when {own} then named_struct('kind', '{kind}', 'label', {label}D, 'form', cast(case pmod(h, {len(forms)}) {form} end as string)) end")
    out = seeds.select("lead", "tail", "h", F.explode(F.expr(f"filter(array({', '.join(made)}), x -> x.form is not null)")).alias("x"))
    return written(out.selectExpr("concat(lead, x.form, tail) as body", "length(lead) as s0", "length(lead) + length(x.form) as e0", "x.kind", "x.label", "h % 5 = 0 as held"))


def _sql_of(tree, weight: float, names: list[str]) -> str:
    """One regression tree as nested CASEs over the struct `f`."""
    if tree.getClass().getSimpleName() == "LeafNode":
        return f"{weight * float(tree.prediction())!r}D"
    name, at = names[int(tree.split().featureIndex())], float(tree.split().threshold())
    return f"case when f.{name} <= {at!r}D then {_sql_of(tree.leftChild(), weight, names)} else {_sql_of(tree.rightChild(), weight, names)} end"


def fit(docs: DataFrame, precision: float = 0.98, trees: int = 20, depth: int = 4) -> tuple[str, dict[str, float]]:
    """The trees as SQL over a candidate's features `f`, and each kind's threshold of the score.

    A candidate of an example's kind that covers the example has its label; one of another kind that meets it is a
    negative. Where no held-out candidate of a kind is positive, nothing of that kind is added.
    """
    based = base_spans(examples(docs))
    proposed = candidates(based)
    every = []
    for number, kind in enumerate(ALL_KINDS):
        fields = ", ".join(f"'{n}', cast({sql} as double)" for n, sql in _features(kind).items())
        positive = f"case when kind = '{kind}' and x.s <= s0 and e0 <= x.e then label else 0.0D end"
        every.append(f"transform(filter(cand_{kind}, x -> x.s < e0 and s0 < x.e), x -> named_struct('kind', {number}D, {fields}, 'label', {positive}))")
    table = proposed.select("held", F.explode(F.expr(f"concat({', '.join(every)})")).alias("x")).select("held", "x.*")
    names = ["kind", *FEATURES]
    counted = written(table.groupBy(*names, "label", "held").agg(F.count("*").cast("double").alias("weight")))
    train = VectorAssembler(inputCols=names, outputCol="features").transform(counted.where("not held")).coalesce(1).sortWithinPartitions(*names, "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, weightCol="weight", seed=7, maxBins=32).fit(train)
    score = " + ".join(f"({_sql_of(t.rootNode(), float(w), names)})" for t, w in zip(model._call_java("trees"), model.treeWeights, strict=True))
    judged = counted.where("held").select("kind", "label", "weight", F.struct(*names).alias("f")).select("kind", F.expr(f"round({score}, 3)").alias("p"), "label", "weight")
    at = judged.groupBy("kind", "p").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good"))
    run = "over (partition by kind order by p desc rows between unbounded preceding and current row)"
    cuts = at.selectExpr("kind", "p", f"sum(good) {run} / sum(n) {run} as share", "good").where((F.col("share") >= precision) & (F.col("good") > 0)).groupBy("kind").agg(F.min("p").alias("p"))
    found = {int(r.kind): r.p for r in cuts.collect()}
    return score, {k: max(found[i], 0.0) if i in found else 1e9 for i, k in enumerate(ALL_KINDS)}


_SPAN = "struct<s:bigint,e:bigint,b:boolean,k:string,p:double>"
# Spans by their start: a base span (b) ends what it meets; of candidates that meet, the higher score stays.
_SWEEP = f"""aggregate(array_sort(concat(known, judged)),
    named_struct('out', cast(array() as array<{_SPAN}>), 'c', cast(null as {_SPAN}), 'be', -1L),
    (a, x) -> case
      when x.b then named_struct('out', a.out, 'c', case when a.c.e > x.s then cast(null as {_SPAN}) else a.c end, 'be', greatest(a.be, x.e))
      when x.s < a.be then a
      when a.c is null then named_struct('out', a.out, 'c', x, 'be', a.be)
      when x.s < a.c.e then named_struct('out', a.out, 'c', case when x.p > a.c.p or (x.p = a.c.p and x.e - x.s > a.c.e - a.c.s) then x else a.c end, 'be', a.be)
      else named_struct('out', concat(a.out, array(a.c)), 'c', x, 'be', a.be) end,
    a -> case when a.c is null then a.out else concat(a.out, array(a.c)) end)"""


def find(docs: DataFrame, model: tuple[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, body (the text), base_<kind>: arrays of spans (s, e, v), and extra: array of added spans (s, e, k)."""
    score, thresholds = model or fit(docs)
    found = candidates(base_spans(docs.select("doc_id", text_or_empty().alias("body"))))
    judged, known = [], []
    for number, kind in enumerate(ALL_KINDS):
        fields = ", ".join(f"'{n}', cast({sql} as double)" for n, sql in _features(kind).items())
        scored = f"transform(cand_{kind}, x -> named_struct('s', x.s, 'e', x.e, 'f', named_struct('kind', {number}D, {fields})))"
        with_p = f"transform({scored}, y -> named_struct('s', y.s, 'e', y.e, 'b', false, 'k', '{kind}', 'p', round(transform(array(y.f), f -> {score})[0], 3)))"
        judged.append(f"case when size(cand_{kind}) = 0 then cast(array() as array<{_SPAN}>) else filter({with_p}, y -> y.p >= {thresholds[kind]!r}D) end")
    known = [f"transform(base_{k}, x -> named_struct('s', x.s, 'e', x.e, 'b', true, 'k', '{k}', 'p', 0.0D))" for k in KINDS]
    placed = found.select("doc_id", "body", *(f"base_{k}" for k in KINDS), F.expr(f"concat({', '.join(judged)})").alias("judged"), F.expr(f"concat({', '.join(known)})").alias("known"))
    extra = F.expr(f"case when size(judged) = 0 then cast(array() as array<{_SPAN}>) else {_SWEEP} end")
    return placed.select("doc_id", "body", *(f"base_{k}" for k in KINDS), F.transform(extra, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))).alias("extra"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the hash of the base spans, all spans as text, and the number of added ones."""
    found = find(docs)
    named = lambda kind, spans: f"transform({spans}, x -> concat('{kind}:', x.s, ':', x.e))"
    base = "array_join(concat(" + ", ".join(named(k, f"base_{k}") for k in KINDS) + "), ',')"
    own = lambda k: f"transform(filter(extra, x -> x.k = '{k}'), x -> named_struct('s', x.s, 'e', x.e))"
    every = {k: f"array_sort(concat(transform(base_{k}, x -> named_struct('s', x.s, 'e', x.e)), {own(k)}))" for k in KINDS} | {"secret": own("secret")}
    both = "array_join(concat(" + ", ".join(named(k, spans) for k, spans in every.items()) + "), ',')"
    return found.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(both).alias("spans"), F.size("extra").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans count as one, n_chars follows.

    A null text stays null. Columns other than text and n_chars are kept as they are, whatever their names. Rows with
    null or equal ids are redacted each on its own.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), "text")
    found = find(rows, fit(docs))
    marked = ", ".join(f"transform(base_{k}, x -> named_struct('s', x.s, 'e', x.e, 'k', '[{k.upper()}]'))" for k in KINDS)
    found = found.withColumn("marks", F.expr(f"array_sort(concat({marked}, transform(extra, x -> named_struct('s', x.s, 'e', x.e, 'k', concat('[', upper(x.k), ']')))))"))
    cleaned = F.expr(
        """case when doc_id.text is null or size(marks) = 0 then doc_id.text else
        aggregate(marks, named_struct('at', 0L, 'out', ''),
          (a, m) -> case when m.e <= a.at then a
             else named_struct('at', m.e, 'out', concat(a.out, case when m.s > a.at then concat(substr(body, cast(a.at + 1 as int), cast(m.s - a.at as int)), m.k) when m.s = a.at then m.k else '' end)) end,
          a -> concat(a.out, substr(body, cast(a.at + 1 as int)))) end"""
    )
    done = found.select("doc_id", cleaned.alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return done.select(*((changed[c] if c in changed else F.col("doc_id").getField(c)).alias(c) for c in docs.columns))
