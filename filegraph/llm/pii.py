"""Personal data: exact base patterns, extended by bootstrapped contextual extraction.

Base: e-mail, ip, card and phone matches (leftmost, non-overlapping, checked); they are the seed entities.
Bootstrapping: the two words to the left of an entity are a lexical pattern. Every identifier-shaped token (four digits
or more) in a pattern's slot is an instance. So are looser shapes of a kind: grouped digits (four to 19, with blanks and
brackets) for cards and phones, addresses without a full domain for e-mails. The left words are those of the whole text,
and opening punctuation before an entity is not one of them. The graph of patterns and instances is scored in rounds: a pattern's score
is the sum of its instances' scores over all its occurrences in the corpus, whatever follows them; an instance's score
is the noisy-or of its patterns'. Patterns of MIN_VALUES different known values and a score of CONFIDENT or more are
high-confidence: whatever identifier-shaped token stands in their slot is a span of the pattern's kind. What one round
finds is known in the next, and the rounds go on until no pattern is new and no score rises.

DataFrame and SQL functions only. Positions come from running sums over the pieces between matches, taken in blocks,
so a text of n matches costs about n steps. Patterns are written so that no text makes them backtrack for long.

Defined results: a null text counts as empty and has no spans. Offsets are code points, end exclusive. Rows that repeat
are all returned. Very long texts are read whole. Of kinds with equal scores the first listed one takes a slot. Any other columns are ignored (`mask` keeps them). No row: no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filegraph.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
MIN_VALUES, CONFIDENT = 3, 0.5
#: The rounds end when no pattern is new and no score rises by more.
RISE = 1e-6
#: Patterns up to this many are constants of the plan that counts them; up to BROADCAST_PATTERNS are sent to every
#: executor; more are joined by shuffle. The counts are the same.
IN_PLAN, BROADCAST_PATTERNS = 2_000, 100_000

# The contract's patterns; possessive where that changes nothing, and not begun inside a run that has just failed.
_FIND = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9]*+(?:[-./_][A-Za-z0-9]++)*+",
    "group": r"(?<![A-Za-z0-9])\+?+(?:\([0-9]{1,5}\)(?:[\x20()./-]{0,3}+[0-9]){1,14}|[0-9](?:[\x20()./-]{0,3}+[0-9]){3,18})(?![A-Za-z0-9])",
    "address": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+",
}
#: The numbers of the shapes that are no kind: a token of any kind, grouped digits of a card or phone, an address of an
#: e-mail; the last two again where a token begins with them, which is then what counts as the instance.
TOKEN, GROUP, ADDRESS, GROUP_2, ADDRESS_2 = range(4, 9)
#: Values and left words longer than this are kept as their digests.
LONG = 160
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_BLOCK, _PIECE = 64, 4096


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(m: str) -> str:
    d = f"reverse(translate({m}, ' -', ''))"
    step = "CAST(substring(d, i, 1) AS INT) * (2 - i % 2)"
    return (
        f"exists(array({d}), d -> length(d) BETWEEN 13 AND 19 AND "
        f"aggregate(sequence(1, length(d)), 0L, (x, i) -> x + {step} DIV 10 + {step} % 10) % 10 = 0)"
    )


def _valid(kind: str, m: str) -> str:
    digits = f"length(regexp_replace({m}, '[^0-9]', ''))"
    return {
        "email": "true",
        "ip": f"{m} RLIKE {_sql(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}",
        "card": _luhn(m),
        "phone": f"{digits} BETWEEN 9 AND 15",
        "token": f"{digits} >= 4",
        "group": f"{digits} BETWEEN 4 AND 19 AND {m} RLIKE '[ ()]|[-./]{{2}}'",
        "address": "true",
    }[kind]


def _short(text: str) -> str:
    return f"CASE WHEN length({text}) > {LONG} THEN sha2({text}, 256) ELSE {text} END"


def _fits(shape: str, kind: str) -> str:
    """Whether a slot of this shape can be of this kind."""
    return f"({shape} = {TOKEN} OR {shape} IN ({GROUP}, {GROUP_2}) AND {kind} IN (2, 3) OR {shape} IN ({ADDRESS}, {ADDRESS_2}) AND {kind} = 0)"


def _with_matches(df: DataFrame, kind: str) -> DataFrame:
    """Add column kind: array of (k, s, e, v, l): kind, start, end, text and the two words to the left of each good match."""
    might = {"email": "instr(__t, '@') > 0", "address": "instr(__t, '@') > 0", "phone": "instr(__t, '+') > 0"}.get(kind, "__digit")
    find = _sql(_FIND[kind])
    df = df.withColumn("__m", F.expr(f"CASE WHEN {might} THEN regexp_extract_all(__t, {find}, 0) END"))
    df = df.withColumn("__g", F.expr(f"CASE WHEN size(__m) > 0 THEN split(__t, {find}, -1) END"))

    # Characters and, in the lower half, runs of blanks: the latter number the word of __w in which a match begins.
    def length(x: str) -> str:
        return f"shiftleft(CAST(length({x}) AS BIGINT), 32) + regexp_count({x}, '\\\\s+')"

    df = df.withColumn("__n", F.expr(f"CASE WHEN size(__m) > 0 THEN zip_with(__g, __m, (g, m) -> {length('g')} + coalesce({length('m')}, 0L)) END"))
    df = df.withColumn("__b", F.expr(f"transform(sequence(0, (size(__n) - 1) DIV {_BLOCK}), b -> aggregate(slice(__n, CAST(b * {_BLOCK} + 1 AS INT), {_BLOCK}), 0L, (x, y) -> x + y))"))
    df = df.withColumn("__p", F.expr("transform(__b, (x, b) -> aggregate(slice(__b, 1, b), 0L, (x, y) -> x + y))"))
    at = f"__p[i DIV {_BLOCK}] + aggregate(slice(__n, CAST((i DIV {_BLOCK}) * {_BLOCK} + 1 AS INT), i % {_BLOCK}), 0L, (x, y) -> x + y) + {length('__g[i]')}"
    df = df.withColumn("__s", F.expr(f"transform(__m, (m, i) -> {at})"))
    # Opening punctuation belongs to the match; what else the match is joined to is the second word of its context.
    df = df.withColumn("__l", F.expr(
        "transform(transform(__s, (x, i) -> named_struct('w', CAST(x & 4294967295L AS INT), 'm', regexp_extract(lower(__m[i]), '^[^\\\\s]+', 0))), "
        "x -> transform(array(substring_index(get(__w, x.w), x.m, 1)), p -> CASE WHEN p RLIKE '^\\\\p{Punct}*$' "
        "THEN concat(nullif(get(__w, x.w - 2), ''), ' ', get(__w, x.w - 1)) ELSE concat(nullif(get(__w, x.w - 1), ''), ' ', p) END)[0])"
    ))
    k = str((*KINDS, "token", "group", "address").index(kind))
    if kind in ("group", "address"):
        first = f"regexp_extract(m, {_sql('^[(+]?+(' + _FIND['token'].split(')', 1)[1] + ')')}, 1)"
        k = f"CASE WHEN {_valid('token', first)} THEN {int(k) + 2} ELSE {k} END"
    s = "CAST(shiftright(__s[i], 32) AS BIGINT)"
    each = f"named_struct('k', {k}, 's', {s}, 'e', {s} + length(m), 'v', {_short('lower(m)')}, 'l', coalesce({_short('__l[i]')}, ''))"
    good = f"filter(transform(__m, (m, i) -> CASE WHEN {_valid(kind, 'm')} THEN {each} END), x -> x IS NOT NULL)"
    empty = "CAST(array() AS ARRAY<STRUCT<k: INT, s: BIGINT, e: BIGINT, v: STRING, l: STRING>>)"
    df = df.withColumn(kind, F.expr(f"coalesce(CASE WHEN size(__m) > 0 THEN {good} END, {empty})"))
    return df.drop("__m", "__g", "__n", "__b", "__p", "__s", "__l")


def _running(df: DataFrame, name: str, of: str, two: str) -> DataFrame:
    """Each element of an array gives way to the largest (or least) of those before it, null at first: block maxima, then within the block."""
    df = df.withColumn("__k", F.expr(f"transform(sequence(0, size({name}) DIV {_BLOCK}), b -> {of}(slice({name}, b * {_BLOCK} + 1, {_BLOCK})))"))
    return df.withColumn(name, F.expr(f"transform({name}, (x, i) -> {two}({of}(slice(__k, 1, i DIV {_BLOCK})), {of}(slice({name}, (i DIV {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}))))")).drop("__k")


def scan(docs: DataFrame, carry: bool = False) -> DataFrame:
    """__id, __own (all columns of docs, if carried), base (checked spans), slots (what has the shape of an identifier outside them)."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("string")
    df = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"), own.alias("__own"))
    df = df.withColumn("__digit", F.col("__t").rlike("[0-9]"))
    df = df.withColumn("__w", F.expr("CASE WHEN __digit OR instr(__t, '@') > 0 THEN split(lower(__t), '\\\\s+', -1) END"))
    for kind in _FIND:
        df = _with_matches(df, kind)
    df = df.withColumn("base", F.concat(*KINDS))
    # In order of their starts, base spans first: a slot is apart if no base span before it reaches into it and none starts in it.
    df = df.withColumn("__x", F.expr("array_sort(concat(transform(base, x -> struct(x.s AS s, 0 AS f, x AS x)), transform(concat(token, `group`, address), x -> struct(x.s AS s, 1 AS f, x AS x))))"))
    df = df.withColumn("__u", F.expr("transform(__x, x -> CASE WHEN x.f = 0 THEN x.x.e END)"))
    df = df.withColumn("__v", F.expr("reverse(transform(__x, x -> CASE WHEN x.f = 0 THEN x.s END))"))
    df = _running(_running(df, "__u", "array_max", "greatest"), "__v", "array_min", "least")
    apart = F.expr("transform(filter(transform(__x, (x, i) -> struct(x.f AS f, x.x AS x, __u[i] AS u, __v[size(__x) - 1 - i] AS v)), y -> y.f = 1 AND coalesce(y.u <= y.x.s, true) AND coalesce(y.v >= y.x.e, true)), y -> y.x)")
    return df.select("__id", "__own", "base", apart.alias("slots"), F.monotonically_increasing_id().alias("__row"))


def _pair(word: str) -> str:
    """SQL: a word with the one before it, as left words are kept."""
    return _short(f"concat(get(w, i - 1), ' ', {word})")


def _totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """l, total: how often each of the patterns, any two words that follow one another, occurs in the texts.

    Up to IN_PLAN patterns are looked up inside each text, which then has one row for each of them that it holds. More
    are joined with all pairs of words, by broadcast or by shuffle as their measured number says.
    """
    own = patterns.select("l").distinct()
    w = docs.select(F.split(F.lower(F.col("text").cast("string")), r"\s+").alias("w"))
    few = [r["l"] for r in own.limit(IN_PLAN + 1).collect()]
    if len(few) > IN_PLAN:
        pairs = w.select(F.explode(F.expr(f"slice(transform(w, (x, i) -> {_pair('x')}), 2, size(w))")).alias("l"))
        return pairs.join(F.broadcast(own) if own.count() <= BROADCAST_PATTERNS else own, "l", "left_semi").groupBy("l").agg(F.count(F.lit(1)).alias("total"))
    listed = lambda names: ", ".join(map(_sql, sorted(names))) or "''"
    # The second word alone rules out most pairs; a digest (it has no blank) stands for words longer than LONG together.
    might = f"x IN ({listed({p.split(' ', 1)[1] for p in few if ' ' in p})}) OR length(x) + length(get(w, i - 1)) >= {LONG}"
    held = w.select(F.expr(f"filter(transform(w, (x, i) -> CASE WHEN {might} THEN {_pair('x')} END), p -> p IN ({listed(few)}))").alias("m"))
    each = F.explode(F.expr("transform(array_distinct(m), p -> named_struct('l', p, 'n', size(filter(m, y -> y = p))))"))
    return held.select(each.alias("x")).groupBy("x.l").agg(F.sum("x.n").alias("total"))


def _patterns(edges: DataFrame) -> DataFrame:
    """l, k, score: the confident patterns of a graph (l, v, k, n, total), fed back round by round until nothing rises."""
    known = edges.filter(F.col("k") < len(KINDS)).select("v", "k", F.lit(1.0).alias("score")).distinct()
    before = None
    while True:
        seen = edges.select("l", "v", "n", "total").join(known, "v")
        patterns = seen.groupBy("l", "k").agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("score"), F.countDistinct("v").alias("values"))
        patterns = staged(patterns.filter((F.col("values") >= MIN_VALUES) & (F.col("score") >= CONFIDENT)).select("l", "k", F.least("score", F.lit(1.0)).alias("score")), "pii-scores")
        # Values score by their patterns alone, so they rise in the next round only if a pattern is new or rose in this one.
        old = before.select("l", "k", F.col("score").alias("old")) if before is not None else patterns.select("l", "k", F.lit(0.0).alias("old")).limit(0)
        if patterns.join(old, ["l", "k"], "left").filter(F.col("score") > F.coalesce("old", F.lit(0.0)) + RISE).isEmpty():
            return patterns
        before = patterns
        found = edges.filter(F.col("k") >= TOKEN).select("l", "v", F.col("k").alias("shape")).join(patterns, "l").filter(_fits("shape", "k"))
        found = found.groupBy("v", "k").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
        seeds = edges.filter(F.col("k") < len(KINDS)).select("v", "k", F.lit(1.0).alias("score")).distinct()
        known = staged(seeds.union(found.select("v", "k", "score")).groupBy("v", "k").agg(F.max("score").alias("score")), "pii-known")


def bootstrap(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """l (left words), k (kind), score: the high-confidence patterns that the seeds lead to, through any number of rounds."""
    slots = scanned.select(F.explode(F.concat("base", "slots")).alias("x")).select("x.*").filter(f"l <> '' AND k < {GROUP_2}")
    edges = slots.groupBy("l", "v", "k").agg(F.count(F.lit(1)).alias("n"))
    many = edges.groupBy("l").agg(F.countDistinct("v").alias("n")).filter(F.col("n") >= MIN_VALUES).select("l")
    edges = staged(edges.join(many, "l", "left_semi"), "pii-edges")
    # A pattern occurs at least as often as something stands in its slot. With these totals all scores come out too high,
    # if anything: what the seeds do not reach so, they never reach, and only what they may reach is counted.
    least = staged(edges.groupBy("l").agg(F.sum("n").alias("total")), "pii-least")
    possible = _patterns(staged(edges.join(least, "l"), "pii-possible")).select("l").distinct()
    return _patterns(staged(edges.join(_totals(docs, possible), "l"), "pii-graph"))


def _joined(spans: str) -> Column:
    ordered = F.expr(f"array_sort(transform({spans}, x -> struct(x.k AS k, x.s AS s, x.e AS e)))")
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def find_spans(docs: DataFrame, carry: bool = False) -> DataFrame:
    """__id, __own, base and added (arrays of k, s, e, v, l): one row for each row of docs."""
    scanned = staged(scan(docs, carry), "pii-scan")
    patterns = bootstrap(docs, scanned)
    slots = scanned.filter(F.size("slots") > 0).select("__row", F.explode("slots").alias("x")).select("__row", "x.*").filter("l <> ''")
    # Each slot takes its best kind; what lies within another found span is part of it.
    new = slots.withColumnRenamed("k", "shape").join(patterns, "l").filter(_fits("shape", "k"))
    new = new.groupBy("__row", "s", "e", "v", "l").agg((-F.max(F.struct("score", (-F.col("k")).alias("k")))["k"]).alias("k"))
    before = Window.partitionBy("__row").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reach", F.max("e").over(before)).filter("reach IS NULL OR e > reach")
    new = new.groupBy("__row").agg(F.collect_list(F.struct("k", "s", "e", "v", "l")).alias("added"))
    new = staged(new, "pii-found")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<k: INT, s: BIGINT, e: BIGINT, v: STRING, l: STRING>>)")
    return scanned.join(new, "__row", "left").select("__id", "__own", "base", F.coalesce("added", none).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = find_spans(docs)
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        F.col("__id").alias("doc_id"), *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("concat(base, added)").alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; a null text stays null. All columns and rows stay."""
    found = find_spans(docs, carry=True)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    # Spans in order, each with what those before it reach to; the text in pieces, as a substring is sought from the start.
    found = found.withColumn("__x", F.expr("array_sort(transform(concat(base, added), x -> struct(x.s AS s, x.e AS e, x.k AS k)))"))
    found = _running(found.withColumn("__u", F.expr("transform(__x, x -> x.e)")), "__u", "array_max", "greatest")
    found = found.withColumn("__t", F.expr(f"CASE WHEN size(__x) > 0 THEN regexp_extract_all(__own.text, '(?s).{{1,{_PIECE}}}', 0) END"))
    part = lambda a, b: (
        f"CASE WHEN {b} > {a} THEN array_join(transform(sequence({a} DIV {_PIECE}, ({b} - 1) DIV {_PIECE}), "
        f"j -> substring(__t[CAST(j AS INT)], CAST(greatest({a} - j * {_PIECE}, 0) + 1 AS INT), CAST(least({b} - j * {_PIECE}, {_PIECE}) - greatest({a} - j * {_PIECE}, 0) AS INT))), '') ELSE '' END"
    )
    shown = f"transform(__x, (x, i) -> CASE WHEN x.s >= coalesce(__u[i], 0) THEN concat({part('coalesce(__u[i], 0L)', 'x.s')}, {names}[x.k]) ELSE '' END)"
    tail = part("array_max(transform(__x, x -> x.e))", "CAST(length(__own.text) AS BIGINT)")
    clean = F.expr(f"CASE WHEN size(__x) = 0 THEN __own.text ELSE concat(array_join({shown}, ''), {tail}) END")
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"__own.`{c}`").alias(c) for c in docs.columns])
