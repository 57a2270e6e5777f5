"""Personal data by weak supervision (operator 7), in DataFrame functions only.

Base patterns give spans that always stay. Further candidates (other formats of the kinds, names, identity and account
numbers, secrets) and the base spans are voted on by labelers: format, gazetteer, context, shape. Expectation-maximisation
over the counts of vote patterns estimates each labeler's reliability (how it votes on true and on false spans) and each
pattern's probability; a logistic regression is trained on those probabilities and decides on the further candidates. Beside the
votes it sees what no labeler looks at: the words on either side (hashed to `BUCKETS`), length, capitals and the share of digits. Vote
patterns are 81 at most and go to the driver; candidates are counted by their features, of which there are finitely many, whatever
the input.

Spans count code points. Regular expressions use possessive or plain character loops only, so that Java's matcher neither
recurses nor rescans on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

# The base kinds and their patterns. The lookbehinds only skip starts from which no match can begin.
KINDS = ("email", "ip", "card", "phone", "id", "iban", "name", "secret")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Further candidates: (kind, pattern).
EXTRA = (
    ("secret", r"(?i:token|secret|password|passwd|api[_-]key) ?[=:] ?\x22[^\x22\n]{8,}+\x22"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63} ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,10}"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]++(?: [A-Z][a-z]++)?"),
)
#: Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int io info biz dev app ai co me tv eu de fr es uk it nl be ch at lu ie pt pl cz sk hu ro bg gr se no dk fi ee lv lt ru ua tr il in cn jp kr au nz ca us mx br ar cl za".split()
GIVEN_NAMES = (
    "james mary john anna peter paul maria thomas michael laura david sarah robert linda william elizabeth richard barbara joseph susan charles jessica christopher karen daniel nancy matthew lisa mark betty "
    "steven margaret andrew sandra george emily edward donna brian carol kevin amanda jason rachel eric janet stephen helen jean pierre jacques marie claire sophie luc michel philippe nicolas isabelle camille julie "
    "hans karl jurgen wolfgang klaus stefan andreas markus heike petra monika ursula sabine greta jose carmen juan luis carlos miguel pedro antonio francisco manuel lucia isabel ana elena rosa pilar diego pablo javier "
    "ivan olga dmitri natasha sergei ahmed fatima omar aisha mohammed wei li chen ying yuki hiroshi kenji priya raj amit sanjay giovanni giulia marco francesca lars erik ingrid sven"
).split()
#: Words before a span that speak for (by kind) or against personal data.
FOR = {"email": "mail|contact|write|reach", "ip": r"\bip\b|host|address|server", "card": "card|visa|payment|credit", "phone": "call|tel|phone|fax|mobile", "id": "ssn|social|identity|passport", "iban": "iban|account|bank", "name": "dear|signed|patient|by", "secret": "key|token|secret|password"}
AGAINST = r"version|isbn|issn|order|figure|page|example|release|build"
VOTERS = ("format", "gazetteer", "context", "shape")
MARK, OTHER = "\ue000", "\ue001"  # private-use characters; the first is replaced by the second in texts
CONTEXT = 40
PRIOR = 0.5
#: Hash buckets of the word before and the word after a span; 0 is for none.
BUCKETS = 16


def _found(text: Column, pattern: str) -> Column:
    """The text cut at the pattern's matches: every second part is one."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def _sums(x: Column) -> Column:
    """0 and the running sums of an array."""
    return F.aggregate(x, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def _let(x: Column, f) -> Column:
    """f of x, with x computed once: a lambda's body would compute it for every element."""
    return F.get(F.transform(F.array(x), f), 0)


def _places(parts: Column) -> Column:
    """Where each part begins, and where the last ends; summed in runs of 256, as an array is copied when it grows."""
    zero = F.lit(0).cast("long")
    sizes = F.transform(parts, lambda p: F.char_length(p).cast("long"))
    cut = lambda sizes: F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(256)), lambda c: _sums(F.slice(sizes, c + 1, F.lit(256))))
    total = lambda runs: _sums(F.transform(runs, lambda r: F.element_at(r, -1)))
    shifted = lambda runs, first: F.transform(runs, lambda r, i: F.transform(F.slice(r, F.lit(2), F.size(r) - 1), lambda n: n + F.get(first, i)))
    return _let(sizes, lambda sizes: _let(cut(sizes), lambda runs: _let(total(runs), lambda first: F.concat(F.array(zero), F.flatten(shifted(runs, first))))))


def _spans(parts: Column, kind: str) -> Column:
    """Matches among parts: kind, start, stop, their text and what stands before."""
    ends = F.when(F.size(parts) > 1, _places(parts)).otherwise(F.array().cast("array<long>"))

    def made(ends: Column) -> Column:
        at = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(kind).alias("kind"), F.get(ends, i).alias("start"), F.get(ends, i + 1).alias("stop"), F.get(parts, i).alias("match"), F.right(F.get(parts, i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after")))

    # One pass over a one-element array binds the running sum to a name.
    return F.flatten(F.transform(F.array(ends), made))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    double = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, double(at(i))).otherwise(at(i))) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(x, r"\."), part)
    if kind == "card":
        return F.when(F.length(_digits(x)).between(16, 19), luhn(_digits(x))).otherwise(False)
    return F.length(_digits(x)).between(8, 15) if kind == "phone" else F.lit(True)


def _voted(s: Column) -> Column:
    """Span s with its votes: 1 for, -1 against, 0 neither."""
    x, kind, low, digits = s.match, s.kind, F.lower(s.match), _digits(s.match)
    three = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    of = lambda k: kind == k
    style = three(s.base | ((of("id")) & ~x.rlike("^(?:000|666|9)")) | of("secret") | of("iban"), of("id") | (of("card") & ~s.base))
    first = F.substring_index(x, ".", 1)
    last = F.regexp_extract(low, r"([a-z]+)[^a-z]*$", 1)
    gazetteer = (
        F.when(of("email"), three(last.isin(TOP_DOMAINS), F.length(last) == 0))
        .when(of("ip"), three(~first.isin("0", "127", "255", "224", "239"), first.isin("0", "127", "255")))
        .when(of("card"), three(digits.rlike("^(?:4|5[1-5]|3[47]|6)"), digits.rlike("^0")))
        .when(of("phone"), three(x.rlike(r"^\+(?:1|33|34|44|49)"), digits.rlike("^(\\d)\\1+$")))
        .when(of("name"), three(F.exists(F.split(low, " "), lambda w: w.isin(GIVEN_NAMES)), F.lit(False)))
        .when(of("secret"), three(x.rlike(r"[0-9a-f]{16,}|[A-Za-z0-9+/]{20,}"), low.rlike(r"\x22(?:example|password|changeme|x+)")))
        .otherwise(0)
    )
    before = F.lower(s.before)
    spoken = F.lit(False)
    for k, words in FOR.items():
        spoken = spoken | (of(k) & before.rlike(words))
    context = three(spoken, before.rlike(AGAINST))
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(low, "[^0-9a-z]", ""), "")))
    shape = three(variety >= 5, variety <= 3)
    bucket = lambda w: F.when(w == "", 0).otherwise(1 + F.crc32(w) % BUCKETS).cast("int")
    unseen = {
        "length": F.least(F.lit(4), F.floor((s.stop - s.start) / 8)), "digits": F.floor(F.length(digits) * 2 / F.length(x)), "capitals": x.rlike("[A-Z]").cast("int"),
        "previous": bucket(F.regexp_extract(before, r"([a-z]+)[^a-z]*$", 1)), "next": bucket(F.regexp_extract(F.lower(s.after), r"^[^a-z]*([a-z]+)", 1)),
    }
    return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop"), s.base.alias("base"), style.alias("format"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"), *[v.cast("int").alias(k) for k, v in unseen.items()])


def _own(docs: DataFrame) -> str:
    """A beginning of names that no column of docs has, for helper columns."""
    name = "_"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def candidates(docs: DataFrame, name: str = "cands") -> DataFrame:
    """docs with a column of that name: base spans and further candidates (none that overlaps a base span), with their votes."""
    text, own = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, OTHER), _own(docs)
    t = F.col(f"{own}t")
    out = docs.withColumn(f"{own}t", text)
    none = F.array(F.lit(""))
    tests = {"email": F.instr(t, "@") > 0, "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9](?:[ -]?[0-9]){15}"), "phone": F.instr(t, "+") > 0}
    either = "|".join(f"(?:{p})" for _, p in EXTRA)
    cut = {f"{own}{kind}": F.when(tests[kind], _found(t, pattern)).otherwise(none) for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))}
    out = out.withColumns(cut | {f"{own}extra": _found(t, either)})
    base = lambda kind: F.filter(_spans(F.col(f"{own}{kind}"), kind), lambda s: _valid(kind, s.match))
    out = out.withColumn(f"{own}base", F.concat(*[base(k) for k in KINDS[:4]]))

    def named(s: Column) -> Column:
        kind = F.lit(EXTRA[-1][0])
        for k, p in EXTRA[-2::-1]:
            kind = F.when(s.match.rlike(f"^(?:{p})"), k).otherwise(kind)
        return F.struct(kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop"), s.match.alias("match"), s.before.alias("before"), s.after.alias("after"))

    extra = F.transform(_spans(F.col(f"{own}extra"), "-"), named)
    out = out.withColumn(f"{own}more", F.filter(extra, lambda s: ~F.exists(f"{own}base", lambda b: (b.start < s.stop) & (s.start < b.stop))))
    flagged = lambda base: lambda s: _voted_row(s, base)
    return out.select(*docs.columns, F.concat(F.transform(f"{own}base", flagged(True)), F.transform(f"{own}more", flagged(False))).alias(name))


def _voted_row(s: Column, base: bool) -> Column:
    class Span:  # a span's fields, with `base` known
        kind, start, stop, match, before, after = s.kind, s.start, s.stop, s.match, s.before, s.after

    Span.base = F.lit(base)
    return _voted(Span)


# ---------------------------------------------------------------- aggregation of votes


def em(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], float, list]:
    """Dawid and Skene's estimate over counted vote patterns: P(true | pattern), the share of true spans, P(vote | truth)."""
    k = len(counts[0][0]) if counts else 0
    belief = {v: min(max(0.5 + 0.5 * sum(v) / max(k, 1), 0.05), 0.95) for v, _ in counts}
    share, table = 0.5, []
    for _ in range(rounds):
        mass = [sum(n * (1 - belief[v]) for v, n in counts), sum(n * belief[v] for v, n in counts)]
        share = (mass[1] + 1) / (sum(mass) + 2)
        table = []
        for j in range(k):
            rows = []
            for y in (0, 1):
                seen = {vote: PRIOR + (vote == (1 if y else -1)) for vote in (-1, 0, 1)}
                for v, n in counts:
                    seen[v[j]] += n * (belief[v] if y else 1 - belief[v])
                total = sum(seen.values())
                rows.append({vote: x / total for vote, x in seen.items()})
            table.append(rows)
        for v, _ in counts:
            yes, no = share, 1 - share
            for j, vote in enumerate(v):
                yes, no = yes * table[j][1][vote], no * table[j][0][vote]
            belief[v] = yes / (yes + no)
    return belief, share, table


#: What the classifier sees of a span beside its kind and the votes: numbers, and codes of which each has a weight of its own.
NUMBERS, CODES = ("length", "digits", "capitals"), {"previous": BUCKETS + 1, "next": BUCKETS + 1}
FEATURES = (*(f"kind_{k}" for k in KINDS), *VOTERS, *NUMBERS, *(f"{c}_{i}" for c, n in CODES.items() for i in range(n)))


def classifier(cands: DataFrame, name: str = "cands") -> dict[str, float]:
    """Weights of the span classifier (with "bias"), trained on the votes of a table of candidates; empty without candidates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    keys = ["kind", *VOTERS, *NUMBERS, *CODES]
    spans = cands.select(F.explode(name).alias("s")).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).count()
    spans = Workspace(cands.sparkSession, "pii-spans").keep(spans, "spans")
    votes = spans.groupBy(*VOTERS).agg(F.sum("count").alias("n")).collect()  # 3 ** 4 rows at most
    if not votes:
        return {}
    belief, _, _ = em(sorted((tuple(r[v] for v in VOTERS), r["n"]) for r in votes))
    told = F.create_map(*[x for v, p in belief.items() for x in (F.lit("|".join(map(str, v))), F.lit(float(p)))])
    p = F.element_at(told, F.concat_ws("|", *[F.col(v).cast("string") for v in VOTERS]))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (p * F.col("count")).alias("weight")), F.struct(F.lit(0.0).alias("label"), ((1 - p) * F.col("count")).alias("weight"))))
    is_ = lambda c: c.cast("double")
    columns = {f"kind_{k}": is_(F.col("kind") == k) for k in KINDS} | {c: is_(F.col(c)) for c in (*VOTERS, *NUMBERS)} | {f"{c}_{i}": is_(F.col(c) == i) for c, n in CODES.items() for i in range(n)}
    data = spans.withColumn("both", both).select("both.label", "both.weight", *[columns[f].alias(f) for f in FEATURES])
    frame = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data.orderBy(*FEATURES, "label").coalesce(1))
    model = LogisticRegression(regParam=0.001, weightCol="weight", maxIter=100).fit(frame)
    return dict(zip(FEATURES, map(float, model.coefficients))) | {"bias": float(model.intercept)}


def _chosen(weights: dict[str, float], name: str) -> Column:
    """Spans (kind, start, stop, base) that stay, by kind as listed, then start."""

    def stays(s: Column) -> Column:
        if not weights:
            return s.base
        score = F.lit(weights["bias"])
        for k in KINDS:
            score = score + F.when(s.kind == k, weights[f"kind_{k}"]).otherwise(0.0)
        for v in (*VOTERS, *NUMBERS):
            score = score + s[v] * weights[v]
        for c, n in CODES.items():
            score = score + F.get(F.array(*[F.lit(weights[f"{c}_{i}"]) for i in range(n)]), s[c])
        return s.base | (score >= 0)

    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(F.filter(name, stays), lambda s: F.struct(F.element_at(order, s.kind).alias("rank"), s.start.alias("start"), s.stop.alias("stop"), s.kind.alias("kind"), s.base.alias("base")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop"), s.base.alias("base")))


def _with_spans(docs: DataFrame, name: str) -> DataFrame:
    cands = f"{_own(docs)}cands"
    kept = Workspace(docs.sparkSession, "pii").keep(candidates(docs, cands), "cands")
    return kept.withColumn(name, _chosen(classifier(kept, cands), cands)).drop(cands)


def find(docs: DataFrame) -> DataFrame:
    """docs with a column `spans`: array of (kind, start, stop in code points, base).

    Null text: no spans. Nulls, repeated rows and further columns of docs pass through, whatever their names; only a column named
    spans is replaced. An empty table gives an empty one.
    """
    return _with_spans(docs.drop("spans"), "spans")


def mask(docs: DataFrame) -> DataFrame:
    """docs whose text has [KIND] in place of each span; of spans that overlap the first names the kind. Other columns stay."""
    name = f"{_own(docs)}spans"
    found = _with_spans(docs, name)
    spans = F.array_sort(F.transform(name, lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), s.kind.alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring("text", acc.at.cast("int") + 1, (s.start - acc.at).cast("int")), F.lit("["), F.upper(s.kind), F.lit("]"))
        return F.struct(F.greatest(acc.at, s.stop).alias("at"), F.when(s.start >= acc.at, F.concat(acc.out, F.array(piece))).otherwise(acc.out).alias("out"))

    end = lambda acc: F.concat(F.array_join(acc.out, ""), F.substring("text", acc.at.cast("int") + 1, F.length("text")))
    text = F.when(F.size(name) > 0, F.aggregate(spans, begin, step, end)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)
    count = lambda k: F.size(F.filter(base, lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    told = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
