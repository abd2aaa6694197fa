"""Secret scans with DataFrame expressions only: fixed patterns and two Markov models.

Base spans come from three patterns. The method adds tokens that a first-order character
model of random strings explains better than one of ordinary identifiers: the sum of the
log-likelihood ratios over a token's character pairs passes a threshold. Both models are
counted from labelled samples. Spans are found without a scan of matches in Python: the
pieces between matches (``split``) and the matches themselves (``regexp_extract_all``)
alternate, so their running lengths are the positions.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Matches of the two maximal-run patterns that are long enough, found directly.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
THRESHOLD = 15.0
#: Matches of one text whose spans are gathered at a time, spans of which a running maximum is
#: taken together, and characters of a text's pieces in masking.
PART, RUN, CUT = 512, 256, 4096
#: Samples generated for each label; the bound of the training set.
SAMPLES = 4000

# The parts that the generated ordinary identifiers are made of.
PARTS = (
    "user name index value count total buffer stream reader writer server client request response session handler "
    "config option default parent child node tree list array string number vector matrix image video audio frame label "
    "train model layer weight loss batch epoch learning rate language document sentence paragraph character position "
    "nation region customer order line item price quantity discount status comment address phone account balance "
    "the and that with from this have been were their which would there about other into could than then these "
    "nicht werden einer durch haben zwischen entwicklung gesellschaft verantwortung schule heit keit lich ung "
    "pour dans cette comme mais elle leurs toujours gouvernement developpement mentation ation eaux "
    "para como pero cuando desde entre tambien desarrollo informacion cion mente idad ado "
    "internationalization implementation configuration representation understanding responsibilities"
).split()

_SPAN = "array<struct<s: int, k: int, e: int>>"


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``(sample, secret boolean)``: n random strings and n ordinary identifiers by rule.

    Random strings are digests of row numbers in lower and upper hex and in base 64;
    identifiers join three parts in four styles, every tenth with a number behind.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    random = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring(digest, 1, 32))).otherwise(coded).alias("sample"),
        F.lit(True).alias("secret"),
    )
    words = F.array(*[F.lit(w) for w in PARTS])
    part = [F.element_at(words, F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(len(PARTS))).cast("int") + 1) for i in range(3)]
    styles = [
        F.concat_ws("_", *part),
        F.concat(part[0], F.initcap(part[1]), F.initcap(part[2])),
        F.concat_ws("-", *part),
        F.concat(*part),
    ]
    styled = reduce(lambda rest, i: F.when(F.col("id") % 4 == i, styles[i]).otherwise(rest), range(3), styles[3])
    styled = F.when(F.col("id") % 10 == 0, F.concat(styled, F.lit("_"), F.col("id") * 7919)).when(F.col("id") % 10 == 5, F.upper(styled)).otherwise(styled)
    ordinary = spark.range(n).select(styled.alias("sample"), F.lit(False).alias("secret"))
    return random.unionByName(ordinary)


def ratio_table(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row over ``ALPHABET``.

    Pairs are counted by Spark; what reaches the driver is one row per pair and label.
    Null samples and characters outside the alphabet are left out.
    """
    chars = samples.filter("sample is not null").select("secret", F.split("sample", "").alias("c"))
    pairs = chars.filter(F.size("c") > 1).select("secret", F.explode(F.expr("transform(sequence(0, size(c) - 2), i -> concat(c[i], c[i + 1]))")).alias("pair"))
    counts = {(r.secret, r.pair): r["count"] for r in pairs.groupBy("secret", "pair").count().filter(F.length("pair") == 2).collect()}

    def row(secret: bool, a: str) -> list[float]:
        seen = [counts.get((secret, a + b), 0) + smoothing for b in ALPHABET]
        return [log(x / sum(seen)) for x in seen]

    return [r - o for a in ALPHABET for r, o in zip(row(True, a), row(False, a), strict=True)]


def _positions(kind: int, text: str, pattern: str, matches: str) -> Column:
    """Spans of ``matches`` (all matches of ``pattern`` in ``text``, in order)."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    zipped = f"arrays_zip(slice(split({text}, '{quoted}', -1), 1, size({matches})), {matches})"
    one = f"""(acc, x) -> named_struct(
      'at', acc.at + length(x.`0`) + length(x.`{matches}`),
      'out', concat(acc.out, array(named_struct('s', acc.at + length(x.`0`), 'k', {kind}, 'e', acc.at + length(x.`0`) + length(x.`{matches}`)))))"""
    # Spans are gathered PART at a time, so that a text's many matches do not copy one long array for each.
    return F.expr(f"""
      CASE WHEN size({matches}) = 0 THEN CAST(array() AS {_SPAN}) ELSE
        aggregate(
          transform(array({zipped}), z -> transform(sequence(0, (size({matches}) - 1) DIV {PART}), c -> slice(z, c * {PART} + 1, {PART})))[0],
          named_struct('at', 0, 'out', CAST(array() AS array<{_SPAN}>)),
          (all, part) -> transform(array(aggregate(part, named_struct('at', all.at, 'out', CAST(array() AS {_SPAN})), {one})), r -> named_struct('at', r.at, 'out', concat(all.out, array(r.out))))[0],
          all -> flatten(all.out))
      END""")


def _running_ends(spans: str) -> str:
    """SQL: the greatest end of ``spans`` up to each of them. Maxima are taken inside parts of
    RUN spans and over the parts before."""
    return f"""
      transform(array(transform({spans}, x -> x.e)), ends -> CASE WHEN size(ends) = 0 THEN ends ELSE
        transform(array(transform(sequence(0, (size(ends) - 1) DIV {RUN}), c -> slice(ends, c * {RUN} + 1, {RUN}))), parts ->
          transform(array(transform(parts, part -> array_max(part))), tops ->
            flatten(transform(parts, (part, c) ->
              transform(array(coalesce(array_max(slice(tops, 1, c)), 0)), before ->
                transform(part, (e, i) -> greatest(before, array_max(slice(part, 1, i + 1)))))[0])))[0])[0] END)[0]"""


def _apart(spans: str, base: str) -> Column:
    """Those of ``spans`` that overlap none of ``base``, both sorted by start. In the merged order
    a span knows how many base spans start before it or with it: the greatest end of those
    and the start of the next one decide."""
    merged = f"array_sort(concat(transform({base}, x -> named_struct('s', x.s, 'own', 0, 'k', x.k, 'e', x.e)), transform({spans}, x -> named_struct('s', x.s, 'own', 1, 'k', x.k, 'e', x.e))))"
    placed = f"filter(transform({merged}, (x, i) -> named_struct('x', x, 'i', i)), y -> y.x.own = 1)"
    return F.expr(f"""
      CASE WHEN size({base}) = 0 OR size({spans}) = 0 THEN {spans} ELSE
        transform(array(named_struct('starts', transform({base}, x -> x.s), 'ends', {_running_ends(base)})), b ->
          transform(
            filter(transform({placed}, (y, n) -> named_struct('x', y.x, 'j', y.i - n)), y ->
              (y.j = 0 OR get(b.ends, y.j - 1) <= y.x.s) AND (y.j >= size(b.starts) OR get(b.starts, y.j) >= y.x.e)),
            y -> named_struct('s', y.x.s, 'k', y.x.k, 'e', y.x.e)))[0] END""")


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, keep: Column | None = None) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, text, base, added)``, the last two arrays of spans
    ``(s, k, e)`` in code points, end exclusive, sorted by start and then kind.

    Null text counts as empty. Added spans overlap no base span. ``keep`` is carried along
    as the column ``kept``.
    """
    kept = [] if keep is None else ["kept"]
    carried = [] if keep is None else [keep.alias("kept")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carried)
    rows = rows.select(
        "*",
        F.regexp_extract_all("text", F.lit(ASSIGN), 0).alias("m0"),
        F.regexp_extract_all("text", F.lit(LONG_ACCESS), 0).alias("m1"),
        F.regexp_extract_all("text", F.lit(LONG_HEX), 0).alias("m2"),
        F.regexp_extract_all("text", F.lit(TOKEN), 0).alias("m3"),
    )
    values = F.when(F.size("m0") == 0, F.expr("CAST(array() AS array<string>)")).otherwise(F.regexp_extract_all("text", F.lit(ASSIGN), 2))
    ratios = F.array(*[F.lit(x) for x in table])
    width = len(ALPHABET)

    def score(token: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        first = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
        step = lambda acc, c: F.struct((acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(ratios, acc["last"] * width + c))).alias("sum"), c.alias("last"))
        return F.aggregate(codes, first, step, lambda acc: acc["sum"])

    rows = rows.select("*", values.alias("v0"), F.transform("m3", score).alias("r3"))
    likely = F.exists("r3", lambda r: r >= threshold)
    rows = rows.select(
        "doc_id",
        "text",
        *kept,
        "v0",
        _positions(0, "text", ASSIGN, "m0").alias("p0"),
        _positions(1, "text", LONG_ACCESS, "m1").alias("p1"),
        _positions(2, "text", LONG_HEX, "m2").alias("p2"),
        F.when(likely, _positions(3, "text", TOKEN, "m3")).otherwise(F.expr(f"CAST(array() AS {_SPAN})")).alias("p3"),
        "r3",
    )
    rows = rows.select("doc_id", "text", *kept, F.expr("array_sort(concat(filter(p0, (x, i) -> length(v0[i]) >= 6), p1, p2))").alias("base"), F.filter("p3", lambda x, i: F.get("r3", i) >= threshold).alias("p3"))
    return rows.select("doc_id", "text", *kept, "base", _apart("p3", "base").alias("added"))


def secret_spans(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans)``, one row per row.

    Null and empty texts have no span; an empty table gives no rows; extra columns are
    ignored; repeated rows give repeated results. A very long text is one row of one task,
    like any other; n matches in it cost time in proportion to n to the power 1.5 at most,
    a small part of what finding them costs.
    """
    table = ratio_table(labelled_samples(docs.sparkSession) if samples is None else samples)
    found = scan(docs, table, threshold)
    count = [F.expr(f"CAST(size(filter(base, x -> x.k = {k})) AS long) AS n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id",
        *count,
        F.size("added").cast("long").alias("n_markov"),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("array_sort(concat(base, added))").alias("spans"),
    )


def masked(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; columns as they are.

    Spans that overlap or touch are replaced as one. Null texts stay null and texts without
    a span stay as they are; repeated rows are treated alike.
    """
    table = ratio_table(labelled_samples(docs.sparkSession) if samples is None else samples)
    found = scan(docs, table, threshold, keep=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    # A mask begins where no span before reaches; what stands between two of them is read from
    # pieces of CUT characters, since a character's place in a text is found by counting.
    spans = "array_sort(concat(base, added))"
    between = f"""concat(
      substring(get(t.pieces, a DIV {CUT}), a % {CUT} + 1, z - a),
      array_join(slice(t.pieces, a DIV {CUT} + 2, greatest(z DIV {CUT} - a DIV {CUT} - 1, 0)), ''),
      CASE WHEN z DIV {CUT} > a DIV {CUT} THEN substring(coalesce(get(t.pieces, z DIV {CUT}), ''), 1, z % {CUT}) ELSE '' END)"""
    between = between.replace("a DIV", "g.a DIV").replace("a %", "g.a %").replace("z DIV", "g.z DIV").replace("z %", "g.z %").replace("z - a", "g.z - g.a")
    cut = F.expr(f"""
      transform(array({spans}), spans ->
        transform(array({_running_ends("spans")}), ends ->
          transform(array(named_struct(
            'pieces', regexp_extract_all(text, '(?s).{{1,{CUT}}}', 0),
            'gaps', concat(
              transform(
                filter(transform(spans, (x, i) -> named_struct('a', CASE WHEN i = 0 THEN 0 ELSE get(ends, i - 1) END, 'z', x.s, 'first', i = 0)), g -> g.first OR g.a < g.z),
                g -> named_struct('a', g.a, 'z', g.z)),
              array(named_struct('a', element_at(ends, -1), 'z', length(text)))))), t ->
            array_join(transform(t.gaps, g -> {between}), '{mask}'))[0])[0])[0]""")
    clean = F.when(F.size("base") + F.size("added") == 0, F.col("kept.text")).otherwise(cut)
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
