"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span classifier learns from both.

1. Base spans (email, ip, card, phone) are found by one pattern each and kept whatever the model says.
2. Wider patterns give candidates of five families: mail, card (13 to 19 digits), number, secret and name. Labelers vote 1, -1 or nothing (0) on
   each: regex (``strict``, ``checksum``, ``shape``), gazetteers (``known``) and context (``before``, ``after``).
3. Candidates are counted by votes and features with partial sums; what follows runs on that table, whose size is bounded
   by the possible votes. Expectation-maximisation estimates per family how often each labeler gives each vote on personal
   and on other candidates. Its posteriors are the soft labels of a logistic regression over votes and features.
4. Candidates with a score of at least ``threshold`` that no base span touches are added.

Positions are code points, found from the lengths of the pieces between matches, in the row that holds the text. Null and
empty texts have no spans. Very long texts are searched as a whole, in linear time. Texts that are not UTF-8 are read with
U+FFFD for bad bytes. Repeated rows are rows of their own. Ties: a score equal to the threshold is added. Input columns
other than key and text, whatever their names, are not read. An empty table gives an empty result and a model that adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.plans.lineage import cut, scratch_path

# every quantifier that could give back is possessive where giving back cannot help: linear time, no recursion
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before the pattern itself is tried.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
BASE = tuple(PATTERNS)
KINDS = (*BASE, "number", "secret", "name")

TITLE = "Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor"
CANDIDATE = "|".join([
    r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[\p{L}0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[\p{L}0-9-]++)++",
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{20,}+",
    r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    rf"(?<!\p{{L}})(?:{TITLE})\b\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?",
])
CANDIDATE_HINT = rf"@|[0-9]|[(\[]at[)\]]|{TITLE}"
FAMILIES = ("mail", "card", "number", "secret", "name")
LABELERS = ("strict", "checksum", "shape", "known", "before", "after")
#: What a vote counts for before anything is estimated.
STARTING = {"strict": 2, "checksum": 3}
#: A rate that is known, not estimated: how seldom a personal candidate fails its check digit.
FAILED_CHECK = 0.001
FEATURES = ("digits", "plus", "parted", "mixed")
NEAR = 40
BLOCK = 64

# fixed values: what the gazetteer and context labelers know
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|at|ch|be|it"
CALLING = r"\+\s?\(?(?:1|33|34|39|41|43|44|49)\b"
ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|6011|65"
NAMES = "Anna|Maria|Marie|Jean|Pierre|Juan|Jose|Carmen|Hans|Peter|Paul|John|James|Mary|David|Michael|Thomas|Laura|Julia"
CUES = (
    r"\b(?:call|tel|telefon|phone|mobile|fax|(?:e-?)?mail|contact|reach|write to|card|visa|iban|account|ssn|ip|host|"
    r"token|password|secret|api.?key|login|name is|dear|signed)\b"
)
OTHER_CUES = r"(?:version|licen[sc]e|isbn|issn|doi|page|chapter|section|article|figure|table|copyright|©|since|year|[$€£#]\s?$|\bv\.?\s?$)"
OTHER_UNITS = r"^\s?(?:%|€|\$|£|kg|km|cm|mm|years?|ans|años|jahre|pages?|times|bytes)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def starts(steps: Column) -> Column:
    """Sum of the steps before each, block by block, so that time stays near linear; ``steps`` is a bound value."""
    blocks = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.ceil(F.size(steps) / BLOCK).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def inside(block: Column, start: Column) -> Column:
        return F.transform(block, lambda _, i: start + total(F.slice(block, 1, i)))

    def of(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: total(p))
        return let(sums, lambda s: F.flatten(F.transform(parts, lambda p, b: inside(p, total(F.slice(s, 1, b))))))

    return let(F.transform(blocks, lambda b: F.slice(steps, b * BLOCK + 1, BLOCK)), of)


def matches(body: Column, pattern: str, hint: str) -> Column:
    """Structs (start, end, value, left, right) of the leftmost non-overlapping matches in a text; ``left`` and ``right`` are
    what stands near, up to the neighbouring matches."""

    def found(hits: Column, pieces: Column) -> Column:
        steps = F.zip_with(pieces, hits, lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0)))

        def placed(held: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                before = F.get(pieces, i)
                start = F.get(held, i) + F.length(before)
                after = F.get(pieces, i + 1)
                return F.struct(
                    start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"),
                    F.substring(before, F.greatest(F.length(before) - NEAR + 1, F.lit(1)), F.lit(NEAR)).alias("left"), F.substring(after, 1, NEAR).alias("right"),
                )

            return F.transform(hits, one)

        return let(steps, lambda s: let(starts(s), placed))

    hits, pieces = F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.split(body, pattern, -1)
    everything = let(hits, lambda h: let(pieces, lambda p: found(h, p)))
    return F.when(F.regexp(body, F.lit(hint)), everything).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Check digit of a string of 13 to 19 digits."""

    def check(n: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            d = F.substring(n, F.length(n) - i, F.lit(1)).cast("int")
            return a + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.length(n) - 1), F.lit(0), add) % 10 == 0

    return F.when(F.length(number).between(13, 19), let(number, check)).otherwise(False)


def holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(body: Column) -> dict[str, Column]:
    """Kind to array of structs (start, end) of the base spans."""

    def of(kind: str) -> Column:
        kept = F.filter(matches(body, PATTERNS[kind], HINTS[kind]), lambda m: holds(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))

    return {k: of(k) for k in BASE}


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def labelled(c: Column) -> Column:
    """Struct (start, end, kind, family, votes, features) of a candidate."""
    value, left, right = c["value"], F.lower(c["left"]), F.lower(c["right"])
    n = F.length(digits(value))
    mail, name = value.rlike(r"@|[(\[]at[)\]]"), value.rlike(rf"^(?:{TITLE})\b")
    number = value.rlike(r"^[+\x20().0-9-]+$")
    ip = value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    plus = value.startswith("+")
    # a number with a plus sign says phone, one of a card's length card
    card = number & n.between(13, 19) & ~plus
    phone = number & n.between(9, 15)
    family = F.when(mail, "mail").when(name, "name").when(card, "card").when(number, "number").otherwise("secret")
    kind = F.when(mail, "email").when(name, "name").when(~number, "secret").when(ip & holds("ip", value), "ip").when(card, "card").when(phone, "phone").otherwise("number")
    date = value.rlike(r"^(?:(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2})$")
    hexes = value.rlike(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")
    strict = (mail & value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")) | (number & ((plus & n.between(9, 15)) | (ip & holds("ip", value)))) | hexes
    kinds_of_letters = value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int") + value.rlike("[0-9]").cast("int")
    shape = vote(
        (number & n.between(9, 19) & ~date) | (~number & ~mail & ~name & (n >= 6) & (kinds_of_letters >= 2)) | (mail & (F.length(value) <= 64)),
        date | (number & (n < 8)) | (~number & ~mail & ~name & value.rlike("^[A-Za-z]+(?:[-_][A-Za-z0-9]+)+$")),
    )
    known = vote(
        (mail & value.rlike(rf"(?i)(?:\.|dot[)\]]\x20?)(?:{DOMAINS})$")) | (number & (value.rlike(f"^{CALLING}") | (card & digits(value).rlike(f"^(?:{ISSUERS})"))))
        | (name & value.rlike(rf"\b(?:{NAMES})\b")),
        ip & value.rlike(r"^(?:0|127|255)\."),
    )
    votes = [
        vote(strict, date | value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){1,2}$")),
        vote(card & luhn(digits(value)), card & ~luhn(digits(value))),
        shape, known, vote(left.rlike(CUES), left.rlike(OTHER_CUES)), vote(right.rlike(CUES), right.rlike(OTHER_UNITS)),
    ]
    features = [
        F.when(n < 7, 0).when(n < 9, 1).when(n < 13, 2).when(n < 20, 3).otherwise(4), plus.cast("int"),
        value.rlike(r"[\x20().-]").cast("int"), (kinds_of_letters >= 2).cast("int"),
    ]
    return F.struct(
        c["start"].alias("start"), c["end"].alias("end"), kind.alias("kind"), family.alias("family"),
        *[v.cast("int").alias(k) for k, v in zip((*LABELERS, *FEATURES), (*votes, *features), strict=True)],
    )


def located(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, key, one array of (start, end) per base kind, candidates) of every row, written once."""
    rows = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_body"))
    found = base_spans(F.col("_body"))
    candidates = F.transform(matches(F.col("_body"), CANDIDATE, CANDIDATE_HINT), labelled)
    path = scratch_path(docs.sparkSession, "personal-data")
    made = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`"), *[c.alias(f"_{k}") for k, c in found.items()], candidates.alias("_candidates"))
    made.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


# reliabilities and classifier


@dataclass
class Reliabilities:
    """Per family: share of personal candidates, and how often each labeler gives -1, 0 and 1 on other and personal ones."""

    prior: dict[str, float]
    votes: dict[str, dict[str, tuple[list[float], list[float]]]]

    def posterior(self) -> Column:
        def log_odds(family: str) -> Column:
            p = self.prior[family]
            out = F.lit(math.log(p / (1 - p)))
            for name, (other, personal) in self.votes[family].items():
                table = F.array(*[F.lit(math.log(b / a)) for a, b in zip(other, personal, strict=True)])
                out = out + F.get(table, F.col(name) + 1)
            return out

        cases = F.lit(0.0)
        for family in self.prior:
            cases = F.when(F.col("family") == family, log_odds(family)).otherwise(cases)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-cases))


def expectation_maximisation(table: DataFrame, rounds: int = 10, prior_votes: float = 2.0) -> Reliabilities:
    """From candidates counted by family and votes (``n``).

    The first posterior is the share of yes among the votes, weighed by ``STARTING``. Every labeler starts with
    ``prior_votes`` counts that agree with the class, half as many empty and half as many against; a family starts with one of each class.
    """
    yes = sum([(F.col(k) == 1).cast("int") * STARTING.get(k, 1) for k in LABELERS], F.lit(0))
    no = sum([(F.col(k) == -1).cast("int") * STARTING.get(k, 1) for k in LABELERS], F.lit(0))
    posterior = (yes + 1) / (yes + no + 2)
    found = Reliabilities({}, {})
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("labeler"), F.col(k).alias("vote")) for k in LABELERS])).alias("_c")
    for _ in range(rounds):
        scored = table.select("family", "n", posterior.alias("_p"), cells)
        sums = scored.groupBy("family", "_c.labeler", "_c.vote").agg(F.sum(F.col("n") * F.col("_p")).alias("yes"), F.sum("n").alias("n"))
        got = {(r["family"], r["labeler"], r["vote"]): (r["n"] - r["yes"], r["yes"]) for r in sums.collect()}
        prior, votes = {}, {}
        for family in sorted({f for f, _, _ in got}):
            held = {k: [got.get((family, k, v), (0.0, 0.0)) for v in (-1, 0, 1)] for k in LABELERS}
            no_sum, yes_sum = (sum(c[y] for c in held[LABELERS[0]]) for y in (0, 1))
            prior[family] = (yes_sum + 1) / (no_sum + yes_sum + 2)
            votes[family] = {}
            for k in LABELERS:
                pair = []
                for y in (0, 1):
                    counts = [c[y] + prior_votes * (1.0 if v == 2 * y - 1 else 0.5) for c, v in zip(held[k], (-1, 0, 1), strict=True)]
                    rates = [c / sum(counts) for c in counts]
                    if k == "checksum" and y == 1:
                        rates = [FAILED_CHECK, *[r * (1 - FAILED_CHECK) / sum(rates[1:]) for r in rates[1:]]]
                    pair.append(rates)
                votes[family][k] = (pair[0], pair[1])
        found = Reliabilities(prior, votes)
        posterior = found.posterior()
    return found


def inputs() -> dict[str, Column]:
    """Inputs of the classifier, all 0 or 1 but for the votes."""
    out = {f"{k}_{name}": (F.col(k) == v).cast("double") for k in LABELERS for v, name in ((1, "yes"), (-1, "no"))}
    out |= {f"family_{f}": (F.col("family") == f).cast("double") for f in FAMILIES}
    out |= {f"digits_{i}": (F.col("digits") == i).cast("double") for i in range(5)}
    return out | {k: F.col(k).cast("double") for k in FEATURES if k != "digits"}


@dataclass
class SpanModel:
    reliabilities: Reliabilities
    weights: dict[str, float] | None
    intercept: float = 0.0

    def score(self) -> Column:
        """Of columns named as the fields of a candidate; a model of no candidates gives 0."""
        if self.weights is None:
            return F.lit(0.0)
        made = inputs()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.intercept) + sum((made[k] * w for k, w in self.weights.items()), F.lit(0.0)))))


def counted(found: DataFrame) -> DataFrame:
    """Candidates by family, votes and features: at most as many rows as there are combinations."""
    rows = found.select(F.explode("_candidates").alias("c")).select("c.*")
    return rows.groupBy("family", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n"))


def fit(found: DataFrame, rounds: int = 10, l2: float = 1e-4) -> SpanModel:
    table = cut(counted(found).coalesce(1).sortWithinPartitions("family", *LABELERS, *FEATURES))
    reliabilities = expectation_maximisation(table, rounds)
    if not reliabilities.prior:
        return SpanModel(reliabilities, None)
    made = inputs()
    soft = table.withColumn("_p", reliabilities.posterior()).select(
        *[c.alias(k) for k, c in made.items()], F.explode(F.array(F.struct(F.lit(1.0).alias("y"), (F.col("n") * F.col("_p")).alias("w")), F.struct(F.lit(0.0).alias("y"), (F.col("n") * (1 - F.col("_p"))).alias("w")))).alias("s")
    )
    rows = VectorAssembler(inputCols=list(made), outputCol="x").transform(soft.select(*made, "s.y", "s.w")).coalesce(1)
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=l2, standardization=False, maxIter=60, tol=1e-7).fit(rows)
    return SpanModel(reliabilities, dict(zip(made, model.coefficients.toArray().tolist(), strict=True)), float(model.intercept))


def added_spans(found: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """(row, kind, start, end, score) of the candidates the model takes and no base span touches."""
    fields = ("family", *LABELERS, *FEATURES)
    rows = found.where(F.size("_candidates") > 0).select("_row", F.explode("_candidates").alias("c"))
    taken = rows.select("_row", "c.kind", "c.start", "c.end", *[f"c.{k}" for k in fields]).withColumn("score", model.score())
    taken = taken.where(F.col("score") >= threshold).select("_row", "kind", "start", "end", "score", F.lit(False).alias("_base"))
    bases = found.select("_row", F.explode(F.concat(*[f"_{k}" for k in BASE])).alias("s"))
    bases = bases.select("_row", F.lit("").alias("kind"), "s.start", "s.end", F.lit(1.0).alias("score"), F.lit(True).alias("_base"))
    order = Window.partitionBy("_row").orderBy("start", F.desc("_base"))
    back = Window.partitionBy("_row").orderBy(F.desc("start"), "_base")  # a frame that grows is linear, one that shrinks is not
    reached = F.max(F.when(F.col("_base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("_base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    both = taken.unionByName(bases).withColumns({"_reached": F.coalesce(reached, F.lit(0)), "_next": following})
    free = (F.col("_reached") <= F.col("start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("end")))
    return both.where(~F.col("_base") & free).select("_row", "kind", "start", "end", "score")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_array(names: list[Column]) -> Column:
    """All base spans of a row as structs that begin with a name of their kind."""

    def named(kind: str, name: Column) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(name, s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*[named(k, n) for k, n in zip(BASE, names, strict=True)])


def span_report(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    The counts and the digest are those of the base spans.
    """
    found = located(docs, text, key)
    added = added_spans(found, fit(found), threshold)
    no = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    added = added.groupBy("_row").agg(F.collect_list(F.struct(no.alias("no"), "start", "end")).alias("_added"))
    base = base_array([F.lit(i + 1).alias("no") for i in range(len(BASE))])
    joined = found.drop("_candidates").withColumn("_base", base).join(added, "_row", "left")
    every = F.when(F.col("_added").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", F.col("_added"))))
    return joined.select(
        F.col(f"`{key}`"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"),
    )


def find_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, kind, start, end, score) of all spans; base spans have score 1."""
    found = located(docs, text, key)
    base = found.select("_row", F.explode(base_array([F.lit(k).alias("kind") for k in BASE])).alias("s"))
    base = base.select("_row", "s.*", F.lit(1.0).alias("score"))
    keys = found.select("_row", F.col(f"`{key}`"))
    return keys.join(base.unionByName(added_spans(found, fit(found), threshold)), "_row").drop("_row")


def masked(text: Column, kinds: Sequence[str] = BASE) -> Column:
    """A text with every base span of the given kinds replaced by its kind in brackets, one kind after the other."""

    def without(body: Column, kind: str) -> Column:
        def filled(piece: Column, match: Column) -> Column:
            return F.concat(piece, F.when(match.isNull(), "").when(holds(kind, match["value"]), f"[{kind}]").otherwise(match["value"]))

        parts = F.zip_with(F.split(body, PATTERNS[kind], -1), matches(body, PATTERNS[kind], HINTS[kind]), filled)
        return F.when(F.regexp(body, F.lit(HINTS[kind])), F.array_join(parts, "")).otherwise(body)

    for k in kinds:
        text = let(text, partial(without, kind=k))
    return text
