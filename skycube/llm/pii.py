"""Personal data by weak supervision (operator 6), in DataFrame functions only.

Loose patterns give candidate spans. Three labelers vote on each: a check of its form, a
gazetteer (top-level domains, card issuers, calling codes, area codes, countries of accounts, given
names, reserved networks) and the words before the span. Expectation-maximisation on the counts
of vote patterns, at most 27 for each kind whatever the corpus, estimates how reliable each
labeler is for each kind. Its posteriors are the soft labels from which a naive Bayes
classifier of a span's shape is trained over all candidates; its features are none that a
labeler looks at. A span's score joins both: the odds of its votes and those of its shape.
Spans of the four base kinds always stay; others are added where they are more likely
personal than not.

Defined cases: a null text is an empty one and has no spans. Repeated rows keep a row each and
count each. Without candidates there is nothing to estimate and no span. Null doc_ids are
scanned like others. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from math import exp, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .spans import find_spans, joined, no_spans


class Kind(NamedTuple):
    name: str
    pattern: str
    guard: str  # a cheaper pattern that every match contains
    base: bool = False


# A run that starts a match may follow only another character or the last match, so no start is
# tried twice; possessive quantifiers keep long runs linear and off the stack.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True),
    Kind("local_phone", r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9]{3}[ .-][0-9]{4}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"-[0-9]{2}-[0-9]{4}"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    Kind("person", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", r"(?:Mr|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor)"),
)
RANK = {k.name: i for i, k in enumerate(KINDS)}
LABELERS = ("form", "gazetteer", "context")
CONTEXT = 32

# Gazetteers and context words. Country domains are any two letters.
DOMAINS = "com org net edu gov mil int info biz name pro aero coop museum jobs mobi tel travel cat asia post app dev cloud online shop site blog tech store"
ISSUERS = r"^(?:4|5[1-5]|2(?:2[2-9]|[3-6]|7[01]|720)|3[47]|6011|65|64[4-9]|35|3(?:0[0-5]|[68]))"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|35[0-9]|37[0-9]|38[0-9]|42[013]|85[2356]|88[06]|96[0-8]|97[1-7])(?:[^0-9]|[0-9])"
AREA_CODES = r"^\(?(?![2-9]11)[2-9][0-8][0-9]\)?[ .-]?(?![2-9]11)[2-9]"
ISSUED_SSN = r"^(?:00[1-9]|0[1-9][0-9]|[1-5][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9]|7[0-2][0-9]|73[0-3]|7[56][0-9]|77[0-2])-"
ACCOUNTS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
GIVEN = (
    "Adam Adrian Alan Albert Alejandro Alessandro Alex Alexander Alice Amanda Amelia Amy Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antoine Antonio Arthur Barbara Beatriz Ben Benjamin Bernd Brian Camille Carla Carlos "
    "Carmen Caroline Catherine Charles Charlotte Chloe Christian Christina Christine Christopher Claire Claudia Clara Daniel David Deborah Diana Diego Dirk Donald Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric "
    "Eva Fernando Francisco Frank Friedrich Gabriel George Gerhard Hannah Hans Heinrich Helen Helga Henri Henry Ines Ingrid Isabel Jack Jacob James Jan Jane Javier Jean Jennifer Jessica Joachim Johannes John Jonas Jorge Jose "
    "Joseph Juan Julia Julie Jürgen Karen Karl Katharina Kevin Klaus Laura Leon Linda Lisa Louis Lucas Lucia Luis Manuel Marc Maria Marie Mark Martin Mary Matthew Michael Michel Monika Nancy Nicolas Olivia Pablo Patricia Paul "
    "Pedro Peter Philippe Pierre Rafael Rainer Richard Robert Rosa Ruth Sabine Sandra Sarah Sofia Sophie Stefan Steven Susan Thomas Ursula Werner William Wolfgang Yves"
)
GOOD = {
    "email": "mail|write|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|address|adresse|host|server|login|client",
    "card": "card|visa|master|amex|karte|carte|tarjeta|payment|credit",
    "phone": "phone|tel|call|mobile|fax|handy|anruf|telefon|llam",
    "local_phone": "phone|tel|call|mobile|fax",
    "ssn": "ssn|social|security",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "person": "name|dear|from|with|signed|liebe|cher|estimad",
}
BAD = r"isbn|version|serial|token|sha|order|invoice|\bid\b|http|issue|build|page"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits' check sum is 0 modulo 10."""
    back = F.reverse(digits(match))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), add) % 10 == 0


def low_parts(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.when(F.length(x).between(1, 3), x.cast("int")).otherwise(0) <= 255))


def account_check(match: Column) -> Column:
    """Whether an account number is 1 modulo 97, letters as 10 to 35 and the first four characters last."""
    plain = F.replace(match, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(plain), F.lit(1))), F.lit(0), add) == 1


def passes(kind: str, match: Column) -> Column:
    """The base rule's own check."""
    n = F.length(digits(match))
    return {"email": F.lit(True), "ip": low_parts(match), "card": n.between(14, 19) & F.when(n.between(14, 19), luhn(match)).otherwise(False), "phone": n.between(10, 15)}.get(kind, F.lit(False))


def votes(kind: str, match: Column, before: Column) -> dict[str, Column]:
    """1 for personal, 0 against, -1 for none."""
    n = F.length(digits(match))
    plain = F.replace(match, F.lit(" "))
    form = {
        "email": F.rlike(match, F.lit(r"^[^.].*[^.]@.*\.[A-Za-z]{2,}$")) & ~F.contains(match, F.lit("..")),
        "ip": low_parts(match) & ~F.rlike(match, F.lit(r"(?:^|\.)0[0-9]")),
        "card": passes("card", match),
        "phone": n.between(10, 15),
        "local_phone": F.rlike(match, F.lit(r"^(?:\([0-9]{3}\) ?[0-9]{3}-|[0-9]{3}([ .-])[0-9]{3}\1)[0-9]{4}$")),
        "ssn": ~F.rlike(match, F.lit(r"^(?:000|666|9)|-00-|-0000$")),
        "iban": account_check(match),
        "person": F.rlike(match, F.lit(r" [A-Z][a-z]{2,}")),
    }[kind]
    known = {
        "email": F.rlike(F.lower(F.element_at(F.split(match, r"\."), -1)), F.lit("^(?:[a-z]{2}|" + DOMAINS.replace(" ", "|") + ")$")),
        "ip": ~F.rlike(match, F.lit(r"^(?:0|127|255|22[4-9]|2[3-5][0-9])\.")),
        "card": F.rlike(digits(match), F.lit(ISSUERS)),
        "phone": F.rlike(match, F.lit(CALLING_CODES)),
        "local_phone": F.rlike(match, F.lit(AREA_CODES)),
        "ssn": F.rlike(match, F.lit(ISSUED_SSN)),
        "iban": F.concat(F.substring(plain, 1, 2), F.length(plain).cast("string")).isin(ACCOUNTS.split()),
        "person": F.rlike(match, F.lit(r" (?:" + GIVEN.replace(" ", "|") + r")(?![a-z])")),
    }[kind]
    context = F.when(F.rlike(F.lower(before), F.lit(BAD)), 0).when(F.rlike(F.lower(before), F.lit(GOOD[kind])), 1).otherwise(-1)
    return {"form": form.cast("int"), "gazetteer": known.cast("int"), "context": context}


def shape(match: Column, before: Column) -> dict[str, Column]:
    """Features of the final classifier: lengths, signs and neighbours, not what the labelers look at."""
    return {
        "digits": F.least(F.length(digits(match)), F.lit(24)).cast("string"),
        "separators": F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(8)).cast("string"),
        "touches": F.when(before == "", "start").when(F.rlike(before, F.lit(r"\s$")), "blank").when(F.rlike(before, F.lit(r"[A-Za-z0-9]$")), "word").otherwise("sign"),
        "variety": F.least(F.size(F.array_distinct(F.split(match, ""))), F.lit(16)).cast("string"),
        "last": F.when(F.rlike(match, F.lit("[0-9]$")), "digit").when(F.rlike(match, F.lit("[A-Z]$")), "capital").otherwise("letter"),
    }


FEATURES = ("digits", "separators", "touches", "variety", "last")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): candidate spans with base flag, votes and features; no text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    raw = [F.when(F.contains(text, F.lit("@")) if k.guard == "@" else F.rlike(text, F.lit(k.guard)), find_spans(text, k.pattern, CONTEXT)).otherwise(no_spans()).alias(k.name) for k in KINDS]
    rows = rows.select("doc_id", *raw)

    def full(k: Kind) -> Column:
        def one(s: Column) -> Column:
            match, before = s["match"], s["before"]
            return F.struct(
                s["start"].alias("start"),
                F.lit(RANK[k.name]).alias("rank"),
                s["end"].alias("end"),
                F.lit(k.name).alias("kind"),
                passes(k.name, match).alias("base"),
                *[v.cast("int").alias(n) for n, v in votes(k.name, match, before).items()],
                *[v.alias(n) for n, v in shape(match, before).items()],
            )

        spans = F.filter(k.name, lambda s: F.length(digits(s["match"])) >= 12) if k.name == "card" else F.col(k.name)
        return F.transform(spans, one)

    return rows.select("doc_id", F.concat(*[full(k) for k in KINDS]).alias("found"))


def expectation_maximisation(patterns: DataFrame, rounds: int = 15) -> dict[str, dict[str, float]]:
    """Per kind: prior, and each labeler's rate of 1 among personal (``t_``) and other (``f_``) spans.

    ``patterns``: kind, form, gazetteer, context, n; at most 27 rows of a kind, which the driver
    takes once. Rates start from the belief that labelers are right more often than not, and
    keep two pseudo-counts of it.
    """
    rows: dict[str, list] = {}
    for r in patterns.collect():
        rows.setdefault(r.kind, []).append(r)
    found = {}
    for kind, seen in sorted(rows.items()):
        x = {"prior": 0.5} | {f"t_{v}": 0.8 for v in LABELERS} | {f"f_{v}": 0.3 for v in LABELERS}
        for _ in range(rounds):
            p = [1 / (1 + exp(-vote_odds(x, r))) for r in seen]
            new = {"prior": (sum(r.n * q for r, q in zip(seen, p)) + 1) / (sum(r.n for r in seen) + 2)}
            for v in LABELERS:
                for mark, start, share in (("t", 1.6, p), ("f", 0.6, [1 - q for q in p])):
                    said = sum(r.n * q for r, q in zip(seen, share) if r[v] >= 0)
                    new[f"{mark}_{v}"] = (sum(r.n * q for r, q in zip(seen, share) if r[v] == 1) + start) / (said + 2)
            x = new
        found[kind] = x
    return found


def vote_odds(x: dict[str, float], r) -> float:
    """Log-odds that a span with these votes is personal, by the rates of its kind."""
    odds = log(x["prior"] / (1 - x["prior"]))
    for v in LABELERS:
        t, f = x[f"t_{v}"], x[f"f_{v}"]
        odds += log(t / f) if r[v] == 1 else log((1 - t) / (1 - f)) if r[v] == 0 else 0.0
    return odds


def voted(found: dict[str, dict[str, float]], get) -> Column:
    """The same as a column; ``get(name)`` gives the span's kind and votes."""
    out = F.lit(0.0)
    for kind, x in found.items():
        odds = F.lit(log(x["prior"] / (1 - x["prior"])))
        for v in LABELERS:
            t, f = x[f"t_{v}"], x[f"f_{v}"]
            odds = odds + F.when(get(v) == 1, log(t / f)).when(get(v) == 0, log((1 - t) / (1 - f))).otherwise(0.0)
        out = F.when(get("kind") == kind, odds).otherwise(out)
    return out


def posterior(found: dict[str, dict[str, float]]) -> Column:
    """Probability that a span with these votes is personal. Columns kind and the labelers."""
    return 1 / (1 + F.exp(-voted(found, F.col)))


def classifier(spans: DataFrame, found: dict[str, dict[str, float]]) -> dict[str, float]:
    """Naive Bayes from soft labels: the log-ratio of each feature value of each kind."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])
    counts = (
        spans.groupBy("kind", *FEATURES, *LABELERS).count()
        .select("kind", F.col("count").alias("n"), posterior(found).alias("p"), F.explode(pairs).alias("x"))
        .groupBy("kind", "x.f", "x.v").agg(F.sum(F.col("n") * F.col("p")).alias("t"), F.sum(F.col("n") * (1 - F.col("p"))).alias("o")).collect()
    )
    total: dict[tuple[str, str], list[float]] = {}
    for r in counts:
        s = total.setdefault((r.kind, r.f), [0.0, 0.0, 0])
        s[0] += r.t
        s[1] += r.o
        s[2] += 1
    ratios = {}
    for r in sorted(counts, key=lambda r: (r.kind, r.f, r.v)):
        t, o, k = total[r.kind, r.f]
        ratios[f"{r.kind}|{r.f}|{r.v}"] = log((r.t + 1) / (t + k)) - log((r.o + 1) / (o + k))
    return ratios


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, spans): structs of start, rank, end, kind, base, probability."""
    found = stored(candidates(docs, id_col, text_col), "candidates")
    spans = found.select(F.explode("found").alias("x")).select("x.*")
    rates = expectation_maximisation(spans.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")))
    ratios = classifier(spans, rates)
    table = F.create_map(*[F.lit(x) for pair in (ratios or {"": 0.0}).items() for x in pair])

    def scored(s: Column) -> Column:
        odds = voted(rates, lambda name: s[name])
        for f in FEATURES:
            odds = odds + F.coalesce(table[F.concat_ws("|", s["kind"], F.lit(f), s[f])], F.lit(0.0))
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), (1 / (1 + F.exp(-odds))).alias("probability"))

    kept = F.filter(F.transform("found", scored), lambda s: s["base"] | (s["probability"] >= least))
    return found.select("doc_id", kept.alias("spans"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
