"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a span
classifier decides. Built-in functions only; the driver handles counts of vote patterns, whose number is bounded."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import settle
from hirelake.llm.spans import found

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that they match the same spans in time linear in the text: a match does not begin inside
# a run that has been tried already (unless a match has just ended there), and runs are not given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider patterns, whose spans the vote alone decides.
WIDE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]++)++"
WIDE_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

#: Characters around a span that the context labelers read, and characters of the parts of a text they are cut from.
AROUND, PART = 40, 4096
CONTEXT = {"email": "mail|contact|write|reach|address|courriel|correo", "ip": "ip|host|server|address|login|logged|client|serveur|servidor",
           "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|cell|fax|whatsapp|telefon|anruf|appel|tél|móvil"}
AGAINST = "order|invoice|isbn|issn|serial|version|section|chapter|page|lot|sku|tracking|part no|ref|doi|hash|build"
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|me|app|dev|ai|eu|us|uk|de|fr|es|it|nl|be|ch|at|pl|se|no|dk|fi|ie|pt|cz|ru|ua|cn|jp|kr|in|au|nz|ca|br|mx|ar|za"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92|351|352|353|358|420|421"
LABELERS = ("shape", "structure", "gazetteer", "context", "against", "edges")
THRESHOLD = 0.5
ROUNDS = 50


def _digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def luhn(digits: str) -> Column:
    """Whether the digits in a column pass the Luhn check."""
    return F.expr(f"""aggregate(sequence(1, char_length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1
        THEN cast(substring({digits}, char_length({digits}) - i + 1, 1) AS int)
        ELSE cast(substring('0246813579', cast(substring({digits}, char_length({digits}) - i + 1, 1) AS int) + 1, 1) AS int) END) % 10 = 0""")


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, stamp, kind, start, stop, found, wide, before, after): every match of a base or a wider pattern.

    stamp is the text's hash: rows of equal doc_id are told apart by it.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("stamp", F.xxhash64("text"))
    sources = (("email", 0, EMAIL, "instr(text, '@') > 0"), ("ip", 0, IP, None), ("card", 0, CARD, None), ("phone", 0, PHONE, "instr(text, '+') > 0"),
               ("email", 1, WIDE_EMAIL, r"text RLIKE '[\\[({]at[\\])}]'"), ("phone", 1, WIDE_PHONE, None))

    def of_source(kind: str, wide: int, pattern: str, needs: str | None) -> Column:
        return F.transform(found("text", pattern, needs), lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(wide).alias("wide"), s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found")))

    every = F.concat(*(of_source(*source) for source in sources))
    # Matches of a wide pattern of digits, and digit runs too short to be anything, are sorted out before they become rows.
    worth = F.filter(every, lambda s: (s["kind"] != KINDS.index("card")) | (s["stop"] - s["start"]).between(13, 60))
    # The surroundings are cut out of the part of the text that holds them, so a long text with many matches is neither
    # copied nor counted through for each of them.
    parts = texts.withColumn("worth", worth).withColumn("parts", F.expr(f"CASE WHEN size(worth) > 0 THEN regexp_extract_all(text, '(?s).{{1,{PART}}}', 0) END"))

    def cut(begin: str, length: str) -> str:
        at = f"coalesce(get(parts, cast(({begin}) div {PART} AS int) + {{}}), '')"
        return f"lower(substring(concat({at.format(0)}, {at.format(1)}), ({begin}) % {PART} + 1, {length}))"

    around = F.expr(f"""transform(worth, s -> named_struct('kind', s.kind, 'wide', s.wide, 'start', s.start, 'stop', s.stop, 'found', s.found,
        'before', {cut(f"greatest(s.start - {AROUND}, 0)", f"least(s.start, {AROUND})")}, 'after', {cut("s.stop", str(AROUND))}))""")
    return parts.select("doc_id", "stamp", F.explode(around).alias("s")).select("doc_id", "stamp", "s.*")


def voted(spans: DataFrame) -> DataFrame:
    """``spans`` with base (the base rules hold) and a vote of -1, 0 or 1 from each labeler."""
    is_kind = {k: F.col("kind") == i for i, k in enumerate(KINDS)}
    spans = spans.withColumn("digits", _digits(F.col("found"))).withColumn("n_digits", F.char_length("digits"))
    checked = F.when(is_kind["card"] & F.col("n_digits").between(13, 19), luhn("digits")).otherwise(F.lit(False))
    octets = F.col("found").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    structured = (F.when(is_kind["email"], F.lower("found").rlike(r"[a-z]{2,}$")).when(is_kind["ip"], octets).when(is_kind["card"], checked)
                  .otherwise(F.col("n_digits").between(9, 15)))
    base = (F.col("wide") == 0) & F.when(is_kind["email"], F.lit(True)).otherwise(structured)

    def vote(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, 1)
        return (out.when(no, -1) if no is not None else out).otherwise(0)

    issuer = F.col("digits").rlike(r"^(?:4|5[1-5]|2[2-7]|3[0-8]|6(?:011|4|5))")
    known = F.when(is_kind["email"], F.lower("found").rlike(rf"(?:\.|\bdot[\])}}]\x20?)(?:{TOP_DOMAINS})$")).when(is_kind["card"], issuer).when(
        is_kind["ip"], octets & ~F.col("found").rlike(r"^0*(?:0|2[4-5][0-9])\.")).otherwise(
        F.when(F.col("wide") == 1, F.col("digits").rlike("^[2-9]")).otherwise(F.col("digits").rlike(f"^(?:{CALLING_CODES})")))
    told = F.lit(False)
    for kind, words in CONTEXT.items():
        told = told | (is_kind[kind] & F.col("before").rlike(rf"(?:^|[^\p{{L}}])(?:{words})"))
    return (spans.withColumn("base", base)
            .withColumn("shape", vote(base, ~base & (F.col("wide") == 0)))
            .withColumn("structure", vote(structured, ~structured))
            .withColumn("gazetteer", vote(known, ~known))
            .withColumn("context", vote(told))
            .withColumn("against", F.when(F.col("before").rlike(rf"(?:^|[^\p{{L}}])(?:{AGAINST})[\p{{L}}]*[^\p{{L}}]{{0,6}}$"), -1).otherwise(0))
            .withColumn("edges", vote(~(F.col("before").rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"^[\p{L}\p{N}_]")),
                                      F.col("before").rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"^[\p{L}\p{N}_]")))
            .withColumn("longer", F.when(F.col("stop") - F.col("start") > 16, 1).otherwise(0))
            .withColumn("parted", F.when(F.col("found").rlike(r"[\x20().-]"), 1).otherwise(0)))


#: What the final classifier reads beside the votes.
SHAPES = ("wide", "longer", "parted")
PATTERN = ("kind", *LABELERS, *SHAPES)


def reliabilities(patterns: list[dict], rounds: int = ROUNDS) -> list[float]:
    """Probability that a span of each vote pattern is personal data, by expectation-maximisation.

    Two hidden classes per kind; a labeler has, per kind and class, a share of each of its three votes. Starts from, and
    is smoothed by, the belief that votes are right more often than wrong, which also settles which class is which.
    """
    belief = {1: {1: 6.0, 0: 3.0, -1: 1.0}, 0: {1: 1.0, 0: 3.0, -1: 6.0}}
    shares = {(k, name, c): {v: n / 10 for v, n in belief[c].items()} for k in range(len(KINDS)) for name in LABELERS for c in (0, 1)}
    prior = dict.fromkeys(range(len(KINDS)), 0.5)
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, p in enumerate(patterns):
            k = p["kind"]
            logs = [math.log(prior[k] if c else 1 - prior[k]) + sum(math.log(shares[k, name, c][p[name]]) for name in LABELERS) for c in (0, 1)]
            posterior[i] = 1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1]))))
        for k in prior:
            own = [(p, q) for p, q in zip(patterns, posterior) if p["kind"] == k]
            total, yes = sum(p["n"] for p, _ in own), sum(p["n"] * q for p, q in own)
            prior[k] = (yes + 5) / (total + 10)
            for name in LABELERS:
                for c, mass in ((1, yes), (0, total - yes)):
                    for v in (1, 0, -1):
                        n = sum(p["n"] * (q if c else 1 - q) for p, q in own if p[name] == v)
                        shares[k, name, c][v] = (n + belief[c][v]) / (mass + 10)
    return posterior


def decided(votes: DataFrame) -> DataFrame:
    """(pattern columns, probability) for each vote pattern that occurs: the final span classifier.

    A logistic regression over votes, shape and kind, trained on every pattern twice, with the weights that
    expectation-maximisation gives to its being personal data and to its not being so. The patterns number at most
    4 kinds x 3 ** 6 votes x 2 ** 3 shapes, whatever the input; all spans are counted in them.
    """
    spark = votes.sparkSession
    patterns = [r.asDict() for r in votes.groupBy(*PATTERN).agg(F.count("*").alias("n")).collect()]
    schema = ", ".join(f"{c} int" for c in PATTERN)
    if not patterns:
        return spark.createDataFrame([], f"{schema}, probability double")
    rows = []
    for p, q in zip(patterns, reliabilities(patterns)):
        numbers = [float(p[c]) for c in (*LABELERS, *SHAPES)] + [float(p["kind"] == k) for k in range(len(KINDS))]
        rows += [(*(p[c] for c in PATTERN), numbers, 1.0, p["n"] * q), (*(p[c] for c in PATTERN), numbers, 0.0, p["n"] * (1 - q))]
    known = spark.createDataFrame(rows, f"{schema}, numbers array<double>, label double, weight double").coalesce(1).withColumn("features", array_to_vector("numbers"))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(known)
    return model.transform(known.filter("label = 1")).select(*PATTERN, vector_to_array("probability")[1].alias("probability"))


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, stamp, kind, start, stop, found, base, probability): base spans, and other candidates whose
    probability is ``threshold`` at least and that overlap no base span of their kind.

    Whole texts; a null text is empty. Rows of equal doc_id and text give the same spans, once.
    """
    votes = settle(voted(candidates(docs)), "votes")
    judged = votes.join(F.broadcast(decided(votes)), list(PATTERN))
    kept = judged.filter(F.col("base") | (F.col("probability") >= threshold)).select(
        "doc_id", "stamp", "kind", "start", "stop", "found", "base", "probability").distinct()
    in_text = Window.partitionBy("doc_id", "stamp", "kind").orderBy("start", "stop", "base")
    before = F.max(F.when(F.col("base"), F.col("stop"))).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(F.col("base"), F.col("start"))).over(in_text.rowsBetween(1, Window.unboundedFollowing))
    crossing = (F.coalesce(before, F.lit(-1)) > F.col("start")) | (F.coalesce(behind, F.col("stop")) < F.col("stop"))
    return kept.withColumn("crossing", crossing).filter("base OR NOT crossing").drop("crossing")


def personal_data_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``.

    A null text has no spans; a null doc_id stays null; repeated rows each get a row; other columns, whatever their names,
    are left out; an empty table gives no rows. Work on a long text grows with its length and its number of matches.
    """
    found_spans = personal_data(docs)
    per_document = found_spans.groupBy("doc_id", "stamp").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "stop", "base"))).alias("s"))
    marked = (docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("stamp")).alias("d")
              .join(per_document.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.stamp") == F.col("p.stamp")), "left"))
    kinds = F.array(*map(F.lit, KINDS))
    own = F.coalesce(F.col("p.s"), F.array().cast("array<struct<kind:int,start:int,stop:int,base:boolean>>"))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter(own, lambda s: s["base"])

    def count(i: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")

    return marked.select(
        F.col("d.doc_id").alias("doc_id"), *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(own).alias("spans"))
