"""Secret scans with multipart credential linking, with DataFrame functions only.

Base kinds stand alone: an assignment to a secret's name, an access key id, a long
hexadecimal run. Weak parts (a name=value identifier, a high-variety 40-character token, a
short or loosely named assignment, an endpoint) are common in harmless text, so they are
reported only when complementary parts co-occur: each part's span is widened by a reach to
its scope, and scopes of identifiers, secrets and endpoints of one text are joined as
intervals. A secret counts with an identifier or an endpoint in scope, an identifier or an
endpoint with a secret.

Everything is computed inside the row that holds the text: no shuffle, no key, and a lost
executor costs only its own rows. Spans are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Fewest characters of an assigned value.
LEAST_VALUE = 8
IDENTIFIER = r"""(?<![A-Za-z0-9_])(?i:client_?id|key_?id|access_?key_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}|(?<![A-Z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}"""
WEAK_SECRET = r"""(?<![A-Za-z0-9_])(?i:pwd|pass|private_?key|auth(?:orization)?|credentials?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|(?<![A-Za-z0-9/+=])(?=[A-Za-z/+]*[0-9])(?=[a-z0-9/+]*[A-Z])(?=[A-Z0-9/+]*[a-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"""
ENDPOINT = r"""(?<![A-Za-z0-9])(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]{4,}|(?<![A-Za-z0-9.-])[a-z0-9][a-z0-9.-]*\.amazonaws\.com"""
#: Kinds in the order of equal starts.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENTIFIER, WEAK_SECRET, ENDPOINT)))
#: Code points by which a part reaches beyond its span.
REACH = 240
REDACTED = "[SECRET]"
#: Code points of a part that kept text is cut from.
PART = 4096
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: A text without any of these has nothing to report: identifiers and endpoints need a secret beside them.
ANY_SECRET = "|".join((ASSIGN, ACCESS, HEX, WEAK_SECRET))


def _let(value: str, name: str, body: str) -> str:
    """body with name standing for the value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scanned(items: str, value, plus, zero: str) -> str:
    """An array of struct(x, before): each item with the sum of value(x) over the items before it.

    The items are cut into about as many blocks as a block has items, so n items take about
    n ** 1.5 steps.
    """
    inner = f"transform(b, (x, j) -> named_struct('x', x, 'before', aggregate(slice(b, 1, j), base, (s, y) -> {plus('s', value('y'))})))"
    block = _let(f"aggregate(slice(tops, 1, k), {zero}, (s, y) -> {plus('s', 'y')})", "base", inner)
    body = _let(f"transform(blocks, b -> aggregate(b, {zero}, (s, y) -> {plus('s', value('y'))}))", "tops", f"transform(blocks, (b, k) -> {block})")
    cut = "transform(sequence(0, (greatest(size(a), 1) - 1) div w), k -> slice(a, k * w + 1, w))"
    return f"flatten({_let(items, 'a', _let('cast(greatest(1, ceil(sqrt(size(a)))) as int)', 'w', _let(cut, 'blocks', body)))})"


def _larger(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _spans(found: str, gaps: str, kind: int) -> Column:
    """Spans from the matches and the texts between them, both columns of the row."""
    sizes = f"transform({found}, (m, i) -> named_struct('gap', length({gaps}[i]), 'own', length(m)))"
    placed = _scanned(sizes, lambda x: f"{x}.gap + {x}.own", lambda a, b: f"{a} + {b}", "0")
    spans = f"transform({placed}, p -> named_struct('start', p.before + p.x.gap, 'kind', {kind}, 'end', p.before + p.x.gap + p.x.own))"
    return F.expr(f"if({found} is null or size({found}) = 0, cast(array() as {SPAN}), {spans})")


def _meeting(spans: str, others: str, reach: int, meets: bool = True) -> Column:
    """The interval join by sort and sweep: spans whose scope meets the scope of one of the others, or of none.

    Ends of widened spans and starts of the others are sorted together; a span meets another
    where the largest end among the others that start before it ends lies behind its start.
    """
    events = f"""sort_array(concat(
        transform({others}, o -> named_struct('at', o.start, 'other', 1, 'start', o.start, 'kind', o.kind, 'end', o.end)),
        transform({spans}, o -> named_struct('at', o.end + {2 * reach}, 'other', 0, 'start', o.start, 'kind', o.kind, 'end', o.end))))"""
    never = -(1 << 30)
    swept = _scanned(events, lambda x: f"if({x}.other = 1, {x}.end, {never})", _larger, str(never))
    hit = f"p.before {'>' if meets else '<='} p.x.start - {2 * reach}"
    return F.expr(f"""if(size({spans}) = 0 or size({others}) = 0, {f"cast(array() as {SPAN})" if meets else spans},
        transform(filter({swept}, p -> p.x.other = 0 and {hit}), p -> named_struct('start', p.x.start, 'kind', p.x.kind, 'end', p.x.end)))""")


def scan(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Each row of docs with _base and _added: arrays of struct(start, kind, end) by start, then kind.

    kind is the place in KINDS. A null text is empty and has no spans. Added spans that
    overlap a base span are left out. Columns of docs by the names _base and _added are not
    returned, as the new ones take their place; any other column, whatever its name, is.
    Repeated rows are scanned each; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("_base", "_added")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    return _scan(own, reach).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "_base", "_added")


def _scan(own: DataFrame, reach: int) -> DataFrame:
    """row, t -> row, t, _base, _added."""
    out = own.withColumn("hit", F.col("t").rlike(ANY_SECRET))
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(f"m_{kind}", F.when(F.col("hit"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))))
        out = out.withColumn(f"g_{kind}", F.when(F.col("hit") & (F.size(f"m_{kind}") > 0), F.split("t", pattern, -1)))
    spans = [_spans(f"m_{k}", f"g_{k}", i).alias(f"s_{k}") for i, k in enumerate(KINDS)]
    values = F.transform("m_assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 1))).alias("v")
    out = out.select("row", "t", *spans, values)
    # assignments of short values match, and so hide what they cover, but are dropped
    long_ones = F.filter("s_assign", lambda s, i: F.get(F.col("v"), i) >= LEAST_VALUE)
    out = out.withColumn("_base", F.array_sort(F.concat(F.when(F.size("s_assign") > 0, long_ones).otherwise(F.col("s_assign")), "s_access", "s_hex")))
    secret = KINDS.index("assign")
    out = out.select("row", "t", "_base", "s_access", *[_meeting(f"s_{k}", "_base", 0, meets=False).alias(k) for k in ("weak_secret", "identifier", "endpoint")])
    out = out.withColumn("secrets", F.concat("weak_secret", F.filter("_base", lambda b: b["kind"] == secret))).withColumn("others", F.concat("identifier", "endpoint", "s_access"))
    added = F.array_sort(F.concat(_meeting("weak_secret", "others", reach), _meeting("identifier", "secrets", reach), _meeting("endpoint", "secrets", reach)))
    return out.select("row", "t", "_base", added.alias("_added"))


def described(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = REDACTED, reach: int = REACH, count_col: str | None = None) -> DataFrame:
    """docs with every reported span replaced by a mark, overlapping spans by one; texts without spans, null ones too, stay as they are.

    count_col, if given, counts the code points of changed texts anew. Columns keep their
    names, whatever those are. Repeated rows are changed alike; an empty table gives no rows.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    out = _scan(own, reach).withColumn("all", F.array_sort(F.concat("_base", "_added")))
    swept = _scanned("all", lambda x: f"{x}.end", _larger, "0")
    # a span that starts behind all ends before it opens a mark; what lies between is kept, cut from parts of the text
    gaps = f"transform(filter({swept}, p -> p.x.start >= p.before), p -> named_struct('from', p.before, 'to', p.x.start))"
    last = "aggregate(all, 0, (s, x) -> greatest(s, x.end))"
    part = f"substring(parts[k], greatest(g.from - k * {PART}, 0) + 1, least(g.to - k * {PART}, {PART}) - greatest(g.from - k * {PART}, 0))"
    piece = f"if(g.from >= g.to, '', array_join(transform(sequence(g.from div {PART}, (g.to - 1) div {PART}), k -> {part}), ''))"
    whole = f"array_join(transform(concat({gaps}, array(named_struct('from', {last}, 'to', length(t)))), g -> {piece}), mark)"
    cut = _let(f"regexp_extract_all(t, '(?s).{{1,{PART}}}', 0)", "parts", whole)
    out = out.select("row", "t", "all", F.lit(mark).alias("mark")).select("row", "all", F.expr(f"if(size(all) = 0, null, {cut})").alias("new"))
    new = {text_col: F.coalesce("new", F.col(f"row.`{text_col}`"))} | ({count_col: F.coalesce(F.length("new").cast("long"), F.col(f"row.`{count_col}`"))} if count_col else {})
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, digest of base spans and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("_base", lambda b: b["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(described(F.col("_base")).cast("binary"), 256).alias("base_sha256"), described(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
    )


QUERIES = {"op4_credential_links": op4_credential_links}
ORACLES: dict[str, str] = {}
