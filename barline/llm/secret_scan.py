"""Secret scans with a random forest that removes false positives (operator 10, DataFrame functions only).

A candidate is the value behind the name of a credential and ``=`` or ``:``, whatever it is, or a run of at least 12
characters of a key's alphabet with a digit in it, or of 20 and more capital letters. Its features are its length, its mix and transitions of character classes, the share of it that common
words cover, marks of paths, and the words beside it. A random forest (pyspark.ml), trained from labelled
findings, gives each candidate a probability; the trees then are one SQL expression over the candidates of a row,
so that neither a scan nor a redaction shuffles or calls Python.

Labelled findings are candidates of the corpus: public formats of access keys, and values that mix letters and
digits behind the name of a credential and ``=`` or ``:``, are secrets; all others are not. The forest sees
neither the formats nor the full rule. It learns from at most ``most`` findings of each label, those with the smallest
hashes, and never from the fifth of all values that is held out (``held_out``); ``quality`` counts right and wrong
verdicts on that fifth. The dictionary comes from all documents.

The candidates of a corpus are found once and saved; fitting and judging read that table.

Null and empty texts have no candidates. Texts of any length are searched whole, in stretches of about the root of the
number of candidates: the time grows with that number times its root. Repeated rows give repeated findings.
With findings of one label only, the label stands for the forest. An empty table gives no findings. ``scan`` keeps extra
columns; a column named findings is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import saved

# The alphabet of keys, public formats of access keys, names of credentials.
_NAME = r"(?i:password|passwd|pwd|secret|token|api_?-?key|apikey|auth|credential|access_?key)[A-Za-z_]{0,64}"
#: The value behind a credential's name: up to the closing quote, or to white space and without what ends a sentence.
#: The first two conditions are cheap and refuse nearly all places.
_BEHIND = r"(?<=[=:>\s\"'])(?<=[=:>]\s{0,16}[\"']?)(?<=" + _NAME + r"[\"']?\s{0,16}(?:=>|=|:)\s{0,16}[\"']?)"
_VALUE = r"(?:(?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')|[^\s\"'=:>][^\s\"']*(?<![.,;:)\]}>]))"
#: ``=`` belongs to a key only where the key ends and isn't a credential's name itself.
_PADDING = r"(?:(?<!" + _NAME + r")={1,2}(?=[\"'`]?(?:[\s.,;:)\]}<]|$)))?"
CANDIDATE = _BEHIND + _VALUE + r"|(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+|[A-Z]{20,}+(?![A-Za-z0-9+/_-]))" + _PADDING
FORMATS = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
NAMED = r"(?i)(?:password|passwd|pwd|secret|token|api_?-?key|apikey|auth|credential|access_?key)[A-Za-z_]*[\"']?\s*(?:=|:|=>)\s*[\"']?$"

#: Characters beside a candidate that count as its neighbourhood.
CONTEXT = 40
FEATURES = ("size", "digits", "capitals", "smalls", "changes", "distinct", "words", "slashes", "dashes", "under", "path", "assigned", "quoted", "named", "named_after", "spaced")


#: Candidates of one stretch of a text, at least; a stretch of a text with many has the root of their number.
STRETCH = 64
_FOUND = "array<struct<value:string,before:string,after:string,gap:int,start:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stretches(n: Column, of) -> Column:
    """``of(first, size)`` for stretches of ``n`` things, about as many as each one has: work that is repeated for each stretch,
    or grows with the square of a stretch, then grows with n times its root and not with the square of n."""
    size = F.greatest(F.lit(STRETCH), F.ceil(F.sqrt(n)).cast("int"))
    return _let(size, lambda m: F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), m), lambda first: of(first, m)))


def candidates(text: Column) -> Column:
    """An array of (value, before, after, gap, start) of a text: ``gap`` is how many characters precede it since the last."""
    values = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    length = F.char_length

    def stretch(c: Column, first: Column, m: Column) -> Column:
        own = F.slice(c["values"], first + 1, m)
        pieces = F.arrays_zip(own.alias("value"), F.slice(c["gaps"], first + 1, F.size(own)).alias("gap"))
        return _let(pieces, lambda p: _let(F.array_join(F.transform(p, lambda x: F.concat(x["gap"], x["value"])), ""), lambda t: F.struct(p.alias("pieces"), t.alias("text"), length(t).alias("n"))))

    def placed(parts: Column, k: Column, rest: Column) -> Column:
        """The candidates of stretch ``k``, whose neighbours can stand in the stretches beside it; ``rest`` is what follows all."""
        before = F.coalesce(F.right(F.get(parts, k - 1)["text"], F.lit(CONTEXT)), F.lit(""))
        after = F.left(F.concat(F.coalesce(F.get(parts, k + 1)["text"], F.lit("")), F.when(k >= F.size(parts) - 2, rest).otherwise("")), F.lit(CONTEXT))
        offset = F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda n, x: n + x["n"])
        part = F.get(parts, k)
        context = F.struct(part["pieces"].alias("pieces"), F.concat(before, part["text"], after).alias("text"), length(before).alias("lead"), offset.alias("offset"))

        def of(c: Column) -> Column:
            begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
            starts = F.aggregate(
                c["pieces"], begin,
                lambda acc, x: F.struct((acc["at"] + length(x["gap"]) + length(x["value"])).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + length(x["gap"]))).alias("starts")),
                lambda acc: acc["starts"],
            )

            def neighbours(x: Column) -> Column:
                value, at = x["piece"]["value"], x["start"] + c["lead"]
                first = F.greatest(at - CONTEXT, F.lit(0))
                left = F.substring(c["text"], first + 1, at - first)
                right = F.substring(c["text"], at + length(value) + 1, F.lit(CONTEXT))
                return F.struct(value.alias("value"), left.alias("before"), right.alias("after"), length(x["piece"]["gap"]).alias("gap"), (x["start"] + c["offset"]).alias("start"))

            return F.transform(F.arrays_zip(c["pieces"].alias("piece"), starts.alias("start")), neighbours)

        return _let(context, of)

    def all_of(c: Column) -> Column:
        parts = _stretches(F.size(c["values"]), lambda first, m: stretch(c, first, m))
        rest = F.left(F.element_at(c["gaps"], -1), F.lit(CONTEXT))
        return _let(F.struct(parts.alias("parts"), rest.alias("rest")), lambda x: F.flatten(F.transform(x["parts"], lambda _, k: placed(x["parts"], k, x["rest"]))))

    found = _let(F.struct(values.alias("values"), F.split(text, CANDIDATE, -1).alias("gaps")), all_of)
    return F.coalesce(F.when(text.isNotNull(), found), F.expr(f"cast(array() as {_FOUND})"))


def _left_out(value: Column, pattern: str) -> Column:
    return F.char_length(value) - F.char_length(F.regexp_replace(value, pattern, ""))


def features(value: Column, before: Column, after: Column, dictionary: str) -> list[Column]:
    """FEATURES of a candidate as doubles."""
    size = F.char_length(value).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[A-Z]", "1"), "[a-z]", "2")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    letters = F.lower(value)
    credential = r"(?i)password|passwd|pwd|secret|token|key|auth|credential"
    found = {
        "size": size,
        "digits": _left_out(value, "[0-9]") / size,
        "capitals": _left_out(value, "[A-Z]") / size,
        "smalls": _left_out(value, "[a-z]") / size,
        "changes": (F.char_length(runs) - 1) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "words": (_left_out(letters, dictionary) if dictionary else F.lit(0)) / size,
        "slashes": _left_out(value, "/") / size,
        "dashes": _left_out(value, "-") / size,
        "under": _left_out(value, "_") / size,
        "path": F.when(before.rlike(r"[/\\.@]$") | after.rlike(r"^[/\\.@]"), 1).otherwise(0),
        "assigned": F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).otherwise(0),
        "quoted": F.when(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]"), 1).otherwise(0),
        "named": F.when(before.rlike(f"(?:{credential})\\S*\\s*\\S*$"), 1).otherwise(0),
        "named_after": F.when(after.rlike(f"^\\S*\\s*\\S*(?:{credential})"), 1).otherwise(0),
        "spaced": F.when(before.rlike(r"(?:^|\s)$") & after.rlike(r"^(?:\s|$)"), 1).otherwise(0),
    }
    return [found[name].cast("double").alias(name) for name in FEATURES]


def candidate_rows(docs: DataFrame) -> DataFrame:
    """One row for each candidate: the columns of ``docs`` other than text, and value, before, after, gap, start."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.explode(candidates(F.col("text"))).alias("__c")).select(*rest, "__c.*")


def with_labels(rows: DataFrame) -> DataFrame:
    """Candidate rows with a label: 1 for a secret by format or name, else 0."""
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    secret = F.col("value").rlike(FORMATS) | (F.col("before").rlike(NAMED) & mixed)
    return rows.withColumn("label", F.when(secret, 1.0).otherwise(0.0))


def labelled(docs: DataFrame) -> DataFrame:
    """Candidates of ``docs`` with their labels."""
    return with_labels(candidate_rows(docs.select("text")).select("value", "before", "after"))


def held_out(value: Column) -> Column:
    """A fifth of all values, never learned from."""
    return F.pmod(F.crc32(value.cast("binary")), F.lit(5)) == 2


def dictionary_pattern(docs: DataFrame, words: int = 300) -> str:
    """The most frequent words of three letters and more in all documents, as one pattern, long ones first."""
    found = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(3, 12)).groupBy("word").count()
    common = [r["word"] for r in found.orderBy(F.desc("count"), "word").limit(words).collect()]
    return "|".join(sorted(common, key=lambda w: (-len(w), w)))


@dataclass
class Scanner:
    """A pattern of common words, and the probability of a secret as SQL over a struct ``f`` of FEATURES."""

    dictionary: str
    probability: str


def _tree_sql(node) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return repr(stats[1] / sum(stats)) + "D"
    split = node.split()
    return f"CASE WHEN f.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END"


def fit(docs: DataFrame, **options) -> Scanner:
    """A scanner from the labelled findings of ``docs`` (text)."""
    docs = docs.select("text")
    return fit_rows(saved(candidate_rows(docs)), dictionary_pattern(docs), **options)


def fit_rows(rows: DataFrame, dictionary: str, most: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 10) -> Scanner:
    """A scanner from candidate rows, which are read more than once."""
    found = saved(with_labels(rows.select("value", "before", "after")).where(~held_out(F.col("value"))).distinct())
    counts = dict(found.groupBy("label").count().collect())
    if len(counts) < 2:
        return Scanner(dictionary, f"{max(counts, default=0.0)!r}D")
    order = F.xxhash64("value", "before", "after")
    chosen = []
    for label, count in sorted(counts.items()):
        own = found.where(F.col("label") == label)
        if count > 2 * most:  # little is ordered: a threshold leaves about half as many again as are taken
            own = own.where(F.pmod(order, F.lit(1 << 52)) < int(1.5 * most / count * (1 << 52)))
        chosen.append(own.orderBy(F.pmod(order, F.lit(1 << 52)), "value", "before", "after").limit(most))
    sample = saved(chosen[0].union(chosen[1]))
    rows = sample.select("label", *features(F.col("value"), F.col("before"), F.col("after"), dictionary))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(vectors)
    votes = [_tree_sql(tree.rootNode()) for tree in forest._java_obj.trees()]
    return Scanner(dictionary, f"({' + '.join(votes)}) / {len(votes)}D")


def judge(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """Candidate rows with their probability."""
    described = rows.withColumn("f", F.struct(*features(F.col("value"), F.col("before"), F.col("after"), scanner.dictionary)))
    return described.withColumn("probability", F.expr(scanner.probability)).drop("f")


def quality(rows: DataFrame, scanner: Scanner, threshold: float = 0.5) -> DataFrame:
    """Counts of held-out findings by label and verdict."""
    found = judge(with_labels(rows.select("value", "before", "after")).where(held_out(F.col("value"))).distinct(), scanner)
    return found.groupBy("label", (F.col("probability") >= threshold).alias("is_secret")).agg(F.count("*").alias("n"))


def _judged(found: Column, scanner: Scanner) -> Column:
    """An array of candidates as an array of (value, gap, start, f), f being their FEATURES."""
    return F.transform(found, lambda c: F.struct(c["value"].alias("value"), c["gap"].alias("gap"), c["start"].alias("start"), F.struct(*features(c["value"], c["before"], c["after"], scanner.dictionary)).alias("f")))


def scan(docs: DataFrame, scanner: Scanner, name: str = "findings", found: Column | None = None) -> DataFrame:
    """``docs`` with ``findings``: an array of (value, gap, start, probability), all candidates of the text in order.

    ``found``: the candidates, if a column holds them already.
    """
    own = "__candidates"
    rows = docs.drop(name) if found is None else docs
    rows = rows.withColumn(own, _judged(candidates(F.col("text")) if found is None else found, scanner))
    probability = scanner.probability.replace("f.", "c.f.")
    return rows.withColumn(name, F.expr(f"transform({own}, c -> named_struct('value', c.value, 'gap', c.gap, 'start', c.start, 'probability', {probability}))")).drop(own)


def found(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """One row for each candidate of ``docs``: doc_id, start (in characters), length, value, probability."""
    return _shown(judge(candidate_rows(docs.select("doc_id", "text")), scanner))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", F.char_length("value").alias("length"), "value", "probability")


def _replaced(findings: Column, threshold: float, mark: str) -> Column:
    """The text with the values of secrets replaced."""
    text = F.col("text")
    end = lambda x: x["start"] + F.char_length(x["value"])

    def stretch(all_: Column, first: Column, m: Column) -> Column:
        def of(own: Column) -> Column:
            begin = F.get(own, F.lit(0))["start"] - F.get(own, F.lit(0))["gap"]
            piece = F.substring(text, begin + 1, end(F.element_at(own, -1)) - begin)

            def joined(c: Column) -> Column:
                gap = lambda x: F.substring(c["piece"], x["start"] - x["gap"] - c["begin"] + 1, x["gap"])
                return F.array_join(F.transform(own, lambda x: F.concat(gap(x), F.when(x["probability"] >= threshold, F.lit(mark)).otherwise(x["value"]))), "")

            return _let(F.struct(piece.alias("piece"), begin.alias("begin")), joined)

        return _let(F.slice(all_, first + 1, m), of)

    def whole(all_: Column) -> Column:
        tail = F.substring(text, end(F.element_at(all_, -1)) + 1, F.char_length(text))
        return F.concat(F.array_join(_stretches(F.size(all_), lambda first, m: stretch(all_, first, m)), ""), tail)

    return F.when(text.isNull() | (F.size(findings) == 0), text).otherwise(_let(findings, whole))


def redact(docs: DataFrame, scanner: Scanner, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets of each text replaced by a mark. All other columns stay as they are."""
    columns = docs.columns
    rows = scan(docs, scanner, "__findings")
    return rows.withColumn("text", _replaced(F.col("__findings"), threshold, mark)).select(*columns)


def fit_and_redact(docs: DataFrame, threshold: float = 0.5, mark: str = "[SECRET]", **options) -> DataFrame:
    """``redact`` with a scanner from ``docs`` themselves, whose candidates are searched once."""
    columns = docs.columns
    held = saved(docs.withColumn("__found", candidates(F.col("text"))))
    rows = held.select(F.explode("__found").alias("c")).select("c.*")
    scanner = fit_rows(rows, dictionary_pattern(docs.select("text")), **options)
    rows = scan(held, scanner, "__findings", F.col("__found"))
    return rows.withColumn("text", _replaced(F.col("__findings"), threshold, mark)).select(*columns)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All candidates of ``documents`` and whether each is a secret; values as digests only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = saved(candidate_rows(docs))
    rows = _shown(judge(rows, fit_rows(rows, dictionary_pattern(docs))))
    return rows.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "probability", (F.col("probability") >= 0.5).alias("is_secret"))
