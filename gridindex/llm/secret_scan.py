"""Secrets, by rules and by two character Markov models, in built-in column functions only.

The rules give the base spans. Beside them, every token of MIN_TOKEN characters or more is scored by the log-likelihood
ratio of two first-order character models: one of random strings, trained on what the rules label as secrets, one of
ordinary identifiers, trained on the tokens that no rule touches, whatever their characters. Counts run over all documents;
only the ratio table (at most one entry for a pair of alphabet characters) comes back, to be used as a literal.

Positions, overlaps and redaction are prefix sums and prefix maxima over arrays of matches, in n log n steps for a text of
n matches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridindex.llm.ranges import checkpointed, free

#: The base kinds in the order in which spans with one start are listed, their patterns, and a cheap guard for each.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters of a token; what else stands in a value (a dot, say) is one more letter of the models.
ALPHABET = 66
MIN_TOKEN = 12
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
#: A token is called random where its pairs' ratios sum to more than EVIDENCE and are more than THRESHOLD each on average:
#: short tokens have to be the more marked.
THRESHOLD, EVIDENCE = 1.0, 19.0
#: Spans that one step of the redaction cuts from a stretch of text.
STRETCH = 128


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima or minima of an array: each step joins every value with the one twice as far before it."""
    steps = F.array(*(F.lit(1 << k) for k in range(31)))
    further = lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, join(x, F.get(acc, i - d))).otherwise(x))
    return F.aggregate(steps, values, lambda acc, d: F.when(d >= F.size(acc), acc).otherwise(further(acc, d)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _located(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the leftmost non-overlapping matches; offsets in code points.

    What stands between the matches and the matches themselves alternate, so offsets are running sums of their lengths.
    """
    group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    apart = [group(2).alias("value")] if pattern == ASSIGN else []  # elsewhere the match is the value
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), group(0).alias("match"), *apart)

    def placed(rows: Column) -> Column:
        ends = _scan(F.transform(rows, lambda x: F.length(x["gap"]) + F.length(x["match"])), lambda a, b: a + b)
        at = lambda end, x: F.struct((end - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value" if apart else "match"].alias("value"))
        return F.zip_with(ends, rows, at)

    return _let(F.filter(zipped, lambda x: x["match"].isNotNull()), placed)


def _nothing() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,value:string>>")


def _rules(text: Column) -> Column:
    """All base spans. Documents without the sign of a kind never reach its pattern."""
    sign = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(r"""(?i)(?:passw|secret|token|api_?key)""")
    assign = F.when(sign, F.filter(_located(text, ASSIGN, 0), lambda x: F.length(x["value"]) >= 6)).otherwise(_nothing())
    access = F.when(F.contains(text, F.lit("AKIA")), F.filter(_located(text, ACCESS, 1), lambda x: F.length(x["value"]) >= 20)).otherwise(_nothing())
    digits = F.when(text.rlike(HEX), _located(text, HEX, 2)).otherwise(_nothing())
    return F.concat(assign, access, digits)


def _tokens(text: Column, base: Column) -> Column:
    """The tokens that no base span touches."""

    def apart(rows: Column) -> Column:
        """rows: base spans and tokens by start. A span before may reach into a token, one after may begin in it."""
        reached = _scan(F.transform(rows, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.greatest)
        begins = F.reverse(_scan(F.transform(F.reverse(rows), lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(F.lit(2**31 - 1))), F.least))
        free_ = lambda x: (x["row"]["kind"] == 3) & (x["reached"] <= x["row"]["start"]) & (x["begins"] >= x["row"]["end"])
        return F.transform(F.filter(F.arrays_zip(rows.alias("row"), reached.alias("reached"), begins.alias("begins")), free_), lambda x: x["row"])

    every = _located(text, TOKEN, 3)
    return F.when(~text.rlike(TOKEN), _nothing()).when(F.size(base) == 0, every).otherwise(_let(F.array_sort(F.concat(base, every)), apart))


def _pairs(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?=(..))"), F.lit(1))


def train(docs: DataFrame) -> dict[str, float]:
    """The log-likelihood ratio of each character pair, random over ordinary, from pair counts over all documents.

    Both models are smoothed by one count a pair, so with no samples at all every ratio is 0.
    """
    return _trained(_matched(docs))


def _matched(docs: DataFrame) -> DataFrame:
    """docs with secret_base and secret_tokens: their base spans, and the tokens that none of these touches, with the values."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumn("secret_base", _rules(text))
    return found.withColumn("secret_tokens", _tokens(text, F.col("secret_base")))


def _trained(matched: DataFrame) -> dict[str, float]:
    labelled = lambda random, rows: F.transform(rows, lambda x: F.struct(F.lit(random).alias("random"), x["value"].alias("value")))
    every = F.concat(labelled(True, F.col("secret_base")), labelled(False, F.col("secret_tokens")))
    each = matched.select(F.explode(every).alias("s")).select("s.random", "s.value").filter(F.length("value") >= 2)
    counted = each.select("random", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    rows = counted.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_.=-]{2}$")).collect()  # at most ALPHABET squared
    first: dict[str, list[int]] = {}
    for row in rows:
        total = first.setdefault(row.pair[0], [0, 0])
        total[0] += row.r
        total[1] += row.o
    ratio = lambda n, total: (n + 1) / (total + ALPHABET)
    return {row.pair: math.log(ratio(row.r, first[row.pair[0]][0]) / ratio(row.o, first[row.pair[0]][1])) for row in sorted(rows)} | {f"{a}": math.log((1 / (n + ALPHABET)) / (1 / (m + ALPHABET))) for a, (n, m) in sorted(first.items())}


#: Token characters lie in this range of codes.
LOW, HIGH = ord("+"), ord("z") + 1


def _table(model: dict[str, float]) -> Column:
    """The ratios as an array by the codes of both characters: a lookup does not search. A pair never seen counts as its first letter's unseen pair."""
    letters = [chr(k) for k in range(LOW, HIGH)]
    return F.from_json(F.lit(json.dumps([model.get(a + b, model.get(a, 0.0)) for a in letters for b in letters])), "array<double>")


def _score(value: Column, table: Column) -> Column:
    """The sum of the pairs' log-likelihood ratios."""
    at = lambda p: (F.ascii(p) - LOW) * (HIGH - LOW) + F.ascii(F.substring(p, 2, 1)) - LOW
    return F.aggregate(_pairs(value), F.lit(0.0), lambda acc, p: acc + F.get(table, at(p)))


def spans(docs: DataFrame, model: dict[str, float], threshold: float = THRESHOLD, name: str = "secret_spans") -> DataFrame:
    """docs with one more column (replacing one of that name): array<struct<start, kind, end>>, sorted; kind is an index into KINDS.

    Beyond the base spans come the tokens that none of them touches and that the models call random (THRESHOLD). A null or
    empty text has no spans; repeated rows stay repeated; all other columns stay, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = free(docs, name + "_base")
    found = docs.withColumn(base, _rules(text))
    return found.withColumn(name, _judged(F.col(base), _tokens(text, F.col(base)), model, threshold)).drop(base)


def _judged(base: Column, tokens: Column, model: dict[str, float], threshold: float = THRESHOLD) -> Column:
    """The base spans and those of the tokens that the models call random, sorted, without values."""
    table = _table(model)
    random = lambda x: _score(x["value"], table) > F.greatest(F.lit(threshold) * (F.length(x["value"]) - 1), F.lit(EVIDENCE))
    both = F.concat(base, F.filter(tokens, random))
    return F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def _written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans as kind:start:end in code points.

    Without a model one is trained on docs. A null or empty text has no spans; repeated rows stay repeated; a null doc_id
    stays null; other columns are ignored. Nothing is shuffled but pair counts. Spans and tokens are found once: they are
    written to the shared folder, from which the models are trained and the tokens judged.
    """
    matched = _matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))).drop("text")
    if model is None:
        matched = checkpointed(docs.sparkSession, matched, "secrets")
        model = _trained(matched)
    found = matched.select("doc_id", _judged(F.col("secret_base"), F.col("secret_tokens"), model).alias("secret_spans"))
    base = F.filter("secret_spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("secret_spans")).alias("spans"), count(3).alias("n_random"))


def redact(docs: DataFrame, model: dict[str, float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by the mark (touching or overlapping spans by one); other columns stay.

    A null text stays null; an empty text or table stays as it is; repeated rows stay repeated. n_chars, where present,
    follows the new text.
    """
    name = free(docs, "secret_spans")
    found = spans(docs, train(docs) if model is None else model, name=name)
    text = F.col("text").cast("string")

    def written(rows: Column) -> Column:
        """rows: start, end, before (the greatest end of all spans before). Stretches are cut first, so that no cut counts characters from the text's start."""
        cut = lambda s, a, b: F.substring(s, a + 1, b - a)
        reach = lambda x: F.greatest(x["before"], x["end"])
        stretches = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(STRETCH)), lambda i: F.slice(rows, i, F.lit(STRETCH)))

        def of(some: Column) -> Column:
            lo = F.element_at(some, 1)["before"]
            part = F.struct(cut(text, lo, reach(F.element_at(some, -1))).alias("text"), lo.alias("lo"))
            piece = lambda x, p: F.when((x["before"] > 0) & (x["start"] <= x["before"]), F.lit("")).otherwise(F.concat(cut(p["text"], x["before"] - p["lo"], x["start"] - p["lo"]), F.lit(mark)))
            return _let(part, lambda p: F.array_join(F.transform(some, lambda x: piece(x, p)), ""))

        tail = reach(F.element_at(rows, -1))
        return F.concat(F.array_join(F.transform(stretches, of), ""), cut(text, tail, F.length(text)))

    ends = _scan(F.transform(name, lambda x: x["end"]), F.greatest)
    rows = _let(ends, lambda e: F.transform(F.col(name), lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(i > 0, F.get(e, i - 1)).otherwise(0).alias("before"))))
    changed = F.when(F.size(name) > 0, _let(rows, written)).otherwise(text)
    out = found.withColumn("text", changed).drop(name)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out
