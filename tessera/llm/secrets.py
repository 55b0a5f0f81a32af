"""Secret scans with a random forest that removes false positives (native).

Candidates are long runs of key-like characters. A forest judges each by its
length, character classes and their transitions, common letter pairs, dictionary
coverage, the path it stands under and the words beside it. It is trained from
labelled findings: the caller's, or those of :func:`labelled_findings`, which are
derived from hash values by rule and hold no real key.

Candidates, features and scores are DataFrame expressions; the forest is that of
pyspark.ml, which trains and scores inside the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD_GAP, stored

#: Shortest candidate.
SHORTEST = 16
#: A run of key-like characters; = is one only as the padding at a run's end, elsewhere it parts a name from its value.
_RUN = r"([A-Za-z0-9+/_\-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\-]))?)"
# Words that name a secret, words that name something else, and path parts of material that holds no live keys.
NAMES = "token|secret|key|passw|passwd|password|pwd|auth|bearer|credential|api|apikey|private|access|client"
OTHERS = "commit|sha|sha1|sha256|md5|checksum|digest|hash|uuid|guid|revision|integrity|etag|example|sample|dummy|placeholder|fake|test|isbn|doi|phone|card|order|invoice"
PATHS = "test|tests|spec|fixture|fixtures|example|examples|mock|mocks|sample|samples|doc|docs|vendor|lock"
# Frequent letter pairs of European languages.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur un ie ei qu la el os us".split()
# A small dictionary of words that names, paths and placeholders are made of.
WORDS = (
    "the and that with for from this are was not you all have new more will home page search free time view name list item type data date file image user text code line link post blog news "
    "index main test example sample config default value class function return static public string number array object error message request response server client http https www com org html "
    "version license copyright information access service system process manager handler controller component content document database table column key token secret password your here change insert "
    "replace placeholder abcdef qwerty tion ment lich keit ción eux ando ing able ness"
).split()
FEATURES = [
    "length", "digits", "upper", "lower", "marks", "hexadecimal", "distinct", "letter_digit", "digit_letter", "lower_upper", "upper_lower", "repeats", "pairs", "dictionary", "named", "otherwise", "assigned", "quoted", "in_tests",
]


def candidates(rows: DataFrame) -> DataFrame:
    """Explode the column ``text`` of ``rows`` into word, c, before, after, place, run: every key-like run.

    ``place`` is the number of its word and ``run`` its number in the word, both from
    0. A word with several runs falls into pieces, ``word`` being the run with the
    text to the runs beside it. ``before`` and ``after`` are the three words before
    and the one after, or inside a word the run before with the text in front of it,
    and the text to the next run.
    """
    keep = [c for c in rows.columns if c != "text"]
    # The words are a column of their own: inside the lambda functions an expression would be evaluated for each of them.
    split = rows.select(*keep, F.split(F.coalesce("text", F.lit("")), WORD_GAP).alias("w"))
    w = F.col("w")
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.length(w[i]) >= SHORTEST) & w[i].rlike(_RUN))

    def found(i: Column) -> Column:
        before = F.array_join(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")
        return F.struct(w[i].alias("word"), before.alias("before"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("after"), i.cast("long").alias("place"))

    words = split.select(*keep, F.explode(F.transform(at, found)).alias("f")).select(*keep, "f.*")
    # So are the runs of a word and the texts around them.
    words = words.select(*keep, "before", "after", "place", F.regexp_extract_all("word", F.lit(_RUN), F.lit(1)).alias("runs"), F.split("word", _RUN).alias("gaps"))
    runs, gaps = F.col("runs"), F.col("gaps")

    def piece(c: Column, k: Column) -> Column:
        before = F.when(k == 0, F.col("before")).otherwise(F.concat(F.get(gaps, k - 1), F.get(runs, k - 1)))
        after = F.when(k == F.size(runs) - 1, F.col("after")).otherwise(F.get(gaps, k + 1))
        return F.struct(F.concat(F.get(gaps, k), c, F.get(gaps, k + 1)).alias("word"), c.alias("c"), before.alias("before"), after.alias("after"), F.col("place"), k.cast("long").alias("run"))

    return words.select(*keep, F.explode(F.transform(runs, piece)).alias("f")).select(*keep, "f.*")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """Add the columns of FEATURES to findings (word, c, before, after, path); null parts count as empty."""
    c, low = F.coalesce("c", F.lit("")), F.lower(F.coalesce("c", F.lit("")))
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    gaps = F.greatest(n - 1, F.lit(1.0))
    near = F.lower(F.concat_ws(" ", F.coalesce("before", F.lit("")), F.regexp_extract(F.coalesce("word", F.lit("")), "(?s)^(.*?)" + _RUN, 1)))
    values = {
        "length": n,
        "digits": _count(c, "[0-9]") / n,
        "upper": _count(c, "[A-Z]") / n,
        "lower": _count(c, "[a-z]") / n,
        "marks": _count(c, r"[+/_=\-]") / n,
        "hexadecimal": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "letter_digit": _count(c, "[A-Za-z](?=[0-9])") / gaps,
        "digit_letter": _count(c, "[0-9](?=[A-Za-z])") / gaps,
        "lower_upper": _count(c, "[a-z](?=[A-Z])") / gaps,
        "upper_lower": _count(c, "[A-Z](?=[a-z])") / gaps,
        "repeats": _count(c, r"(.)(?=\1)") / gaps,
        "pairs": _count(low, f"(?=({'|'.join(PAIRS)}))") / gaps,
        "dictionary": (n - F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), ""))) / n,
        "named": near.rlike(f"(^|[^a-z])({NAMES})").cast("double"),
        "otherwise": F.concat_ws(" ", near, F.lower(F.coalesce("after", F.lit("")))).rlike(f"(^|[^a-z])({OTHERS})([^a-z]|$)").cast("double"),
        "assigned": near.rlike(r"[=:]\s*[\"']?$|[=:]>?\s*[\"'`]?$").cast("double"),
        "quoted": F.coalesce("word", F.lit("")).rlike("[\"'`]").cast("double"),
        "in_tests": F.lower(F.coalesce("path", F.lit(""))).rlike(f"(^|[^a-z])({PATHS})([^a-z]|$)").cast("double"),
    }
    return found.withColumns(values)


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Findings with labels (word, c, before, after, path, label), made by rule from hash values.

    Kinds of label 1: hex, base64-like and prefixed keys beside naming words. Kinds of
    label 0: digits alone, digests beside words that name them, joined dictionary
    words, syllable words, placeholders, runs of one character, paths.
    """
    r = spark.range(rows)
    md = lambda salt: F.md5(F.concat(F.col("id").cast("string"), F.lit(salt)))
    drawn: dict[str, Column] = {
        "hex40": F.substring(F.concat(md("a"), md("b")), 1, 40), "hex64": F.concat(md("a"), md("b")), "hex32": md("a"),
        "base": F.substring(F.translate(F.base64(F.unhex(F.concat(md("c"), md("d")))), "+/=", "-_A"), 1, 40),
    }

    def pick(items: list[str], salt: str) -> Column:
        """A column with one of the items for each row."""
        name = f"pick_{salt}_{len(drawn)}"
        drawn[name] = F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(items))) + 1).cast("int"))
        return F.col(name)

    hex40, hex64, hex32, base = (F.col(c) for c in ("hex40", "hex64", "hex32", "base"))
    words = [w for w in WORDS if len(w) > 3]
    syllable = F.concat(*[pick(PAIRS, f"s{k}") for k in range(10)])
    joined = F.concat_ws("_", pick(words, "w1"), pick(words, "w2"), pick(words, "w3"), pick(words, "w4"))
    name = pick(["token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "private_key", "apiKey", "TOKEN", "bearer"], "n")
    sign = pick(["=", ":", " ="], "g")
    tight = pick(["=", ":", '":"', "='"], "t")
    plain = F.concat_ws(" ", pick(["the", "of", "in", "que", "der", "les"], "p1"), pick(words, "p2"), pick(["and", "a", "is", "de", "und"], "p3"))
    other = pick(["commit", "sha256", "checksum", "md5", "uuid", "revision", "example", "dummy", "placeholder"], "o")
    assigned = F.concat_ws(" ", pick(words, "q"), name, F.trim(sign))
    quote = lambda c: F.concat(F.lit('"'), c, pick(['"', '",', '";', '"!!', '".'], "z"))
    kinds = [
        (hex40, assigned, True, 1), (F.upper(hex40), assigned, True, 1), (hex32, assigned, True, 1), (hex64, assigned, False, 1), (base, assigned, True, 1), (base, assigned, False, 1),
        (F.concat(pick(["AKIA", "ghp_", "sk_live_", "xoxb-"], "pre"), F.upper(F.substring(base, 1, 24))), plain, False, 1), (F.concat(pick(["ghp_", "sk_live_", "glpat-"], "pre"), base), assigned, True, 1),
        (F.translate(hex40, "abcdef", "123456"), plain, False, 0), (F.substring(F.translate(hex40, "abcdef", "123456"), 1, 16), plain, False, 0), (F.substring(F.translate(hex40, "abcdef", "123456"), 1, 16), assigned, False, 0),
        (hex40, F.concat_ws(" ", plain, other), False, 0), (hex32, F.concat_ws(" ", plain, other), True, 0), (joined, assigned, True, 0), (joined, plain, False, 0), (syllable, plain, False, 0), (syllable, assigned, True, 0),
        (F.initcap(syllable), plain, False, 0), (F.upper(syllable), plain, False, 0), (F.concat(F.repeat(F.lit("x"), 20), F.substring(hex32, 1, 2)), assigned, True, 0), (F.lit("your_api_key_goes_here"), assigned, True, 0), (F.concat_ws("/", pick(words, "w1"), pick(words, "w2"), syllable), plain, False, 0),
        (hex40, plain, F.concat(other, tight), 0), (hex64, plain, F.concat(other, tight), 0), (hex32, plain, F.concat(F.lit("?"), other, tight), 0), (hex40, plain, F.concat(name, tight), 1), (base, plain, F.concat(name, tight), 1), (base, plain, F.concat(F.lit("&"), name, tight), 1),
    ]
    kind = F.col("id") % len(kinds)
    word, run, before, label = (F.lit(None) for _ in range(4))
    for k, (c, beside, around, y) in enumerate(kinds):
        # What a run stands in: quotes, nothing, or one word with its name.
        whole = F.concat(around, c) if isinstance(around, Column) else quote(c) if around else c
        word, run = F.when(kind == k, whole).otherwise(word), F.when(kind == k, c).otherwise(run)
        before, label = F.when(kind == k, beside).otherwise(before), F.when(kind == k, F.lit(y)).otherwise(label)
    after, path = pick(["", "and", "the", "for", "}", "#"], "f"), pick(["src", "config", "src0", "app", "tests"], "path")
    return stored(r.withColumns(drawn).select(word.alias("word"), run.alias("c"), before.alias("before"), after.alias("after"), path.alias("path"), label.alias("label")), "secret-findings")


def fit_forest(findings: DataFrame, *, trees: int = 24, depth: int = 8, seed: int = 17) -> RandomForestClassificationModel:
    """Train the forest from findings with a label of 0 or 1 (others are left out)."""
    rows = with_features(findings.where("label IN (0, 1)")).select(*FEATURES, F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.9).fit(rows)


def scan_secrets(docs: DataFrame, forest: RandomForestClassificationModel, *, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """Candidates in the whole texts of ``docs`` (doc_id, text), judged by the forest.

    One row per key-like run: doc_id, place (number of its word from 0), run (its
    number in the word from 0), length, masked (its first and last two characters),
    score (0 to 1) and secret (score >= threshold). ``path`` is a column that says where a text comes
    from (default: unknown). Null and empty texts have no candidates, null doc_ids
    pass through, repeated rows give their candidates again, other columns are not
    read, and an empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))).alias("path"), F.col("text"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(rows)).select("doc_id", "place", "run", "c", *FEATURES))
    scored = forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    masked = F.concat(F.substring("c", 1, 2), F.lit("..."), F.substring("c", -2, 2))
    return scored.select("doc_id", "place", "run", F.length("c").cast("long").alias("length"), masked.alias("masked"), "score", (F.col("score") >= threshold).alias("secret"))
