"""Secret scans with a random forest that removes false positives.

Candidates are runs of at least ``LEAST`` characters that keys are written in.
Features are the candidate's length, its character transitions, its coverage by
dictionary words, the path it stands in, and the words around it. The forest is
fitted on the driver from a bounded sample of labelled findings; candidates are
found, described and scored with DataFrame functions only.

Defined results: null and empty texts have no candidates; a null path is an
empty path; a candidate may be as long as the text; repeated rows give repeated
results; an empty table gives an empty result; further columns of the input are
ignored. Positions count code points from 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import forest
from kinmatch.llm.shared import narrowed

LEAST = 16
#: Labelled findings that the forest is fitted on, at most.
TRAINING_ROWS = 4000
CONTEXT = 48
#: A name ends at "="; only as padding at the end does it belong to a candidate.
_RUN = r"[A-Za-z0-9_+/\-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=\-]))?"

# Words whose letters don't look random.
DICTIONARY = (
    "about account admin after again also because been before between build button change check class client code color column comment commit common config connect content copy could count country create data date "
    "default delete detail digest document download email error event example export fake false field file filter first form from function group handle hash have header hello help hidden home house http image import "
    "index input insert integer item language large last license line link list load local long look main make manager many message method model module more name need never node null number object option order other "
    "output package page param parent part path people person place placeholder point print process product profile project property public query random read record remove report request response result return right "
    "root sample save schema script search select send server service session should simple size small some source start state status still storage store string style submit system table target template test text than "
    "that their them then there these they thing think this time title token tree true type under unique update upload user value variable version view water where which while window with word work world would write "
    "xxxx year your tion ment ing able ness ight ould ough ever ation"
).split()
# Words by which a neighbour or path speaks for or against a secret.
FOR_WORDS = "token|secret|passw|passphrase|api.?key|apikey|access.?key|private.?key|auth|bearer|credential|signing"
AGAINST_WORDS = "sha1|sha256|md5|checksum|digest|commit|revision|etag|uuid|guid|example|sample|dummy|placeholder|isbn|order|card|serial|build|hash"
PATH_AGAINST = "test|example|sample|fixture|mock|docs?/|changelog|lock|vendor|node_modules"
PATH_FOR = r"\.env|config|settings|credential|secret|deploy|\.pem|\.ya?ml"

FEATURES = [
    "length", "digit_share", "upper_share", "symbol_share", "distinct_share", "class_changes", "letter_digit_changes", "alternations", "longest_letters", "longest_digits",
    "hex_only", "digits_only", "uuid", "dictionary_share", "repeat_share", "for_before", "against_around", "assigned", "quoted", "path_for", "path_against",
]


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, path, ...) exploded to candidates: start, secret, before, after, and the columns of docs but text."""
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.select(*keep, F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)).alias("runs"), F.split("text", _RUN, -1).alias("gaps")).where(F.size("runs") > 0)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    entry = F.transform(
        "runs",
        lambda run, i: F.struct(
            run.alias("secret"),
            (total(F.slice("gaps", 1, i + 1)) + total(F.slice("runs", 1, i))).alias("start"),
            # a long name is a run itself: before its value it stands with the sign
            F.right(F.when(F.get("gaps", i).rlike("^[\"']?\\s*[=:]"), F.concat(F.coalesce(F.get("runs", i - 1), F.lit("")), F.get("gaps", i))).otherwise(F.get("gaps", i)), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    return rows.select(*keep, F.explode(entry).alias("c")).select(*keep, "c.start", "c.secret", "c.before", "c.after")


def described(found: DataFrame) -> DataFrame:
    """Candidates with the forest's features."""
    c, n = F.col("secret"), F.col("length")
    gone = lambda col, pattern: F.length(F.regexp_replace(col, pattern, ""))
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("double")
    longest = lambda col, other: F.aggregate(F.split(col, other), F.lit(0), lambda m, x: F.greatest(m, F.length(x))).cast("double")
    before, around = F.lower("before"), F.lower(F.concat("before", F.lit(" "), "after"))
    path = F.lower(F.coalesce("path", F.lit("")))
    rows = found.withColumn("length", F.length("secret").cast("double"))
    rows = rows.withColumn("_kind", F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=-_", "A" * 26 + "a" * 26 + "0" * 10 + "-----"))
    rows = rows.withColumn("_sound", F.translate(F.lower(c), "aeiouybcdfghjklmnpqrstvwxz0123456789+/=-_", "v" * 6 + "c" * 20 + "0" * 10 + "-----"))
    rows = rows.withColumns({
        "digit_share": gone(F.col("_kind"), "[^0]") / n,
        "upper_share": gone(F.col("_kind"), "[^A]") / n,
        "symbol_share": gone(F.col("_kind"), "[^-]") / n,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "class_changes": (F.length(F.regexp_replace("_kind", r"(.)\1+", "$1")) - 1) / n,
        "letter_digit_changes": (F.length(F.regexp_replace(F.regexp_replace("_sound", "[vc]", "x"), r"(.)\1+", "$1")) - 1) / n,
        "alternations": (F.length(F.regexp_replace("_sound", r"(.)\1+", "$1")) - 1) / n,
        "longest_letters": longest(c, "[^A-Za-z]"),
        "longest_digits": longest(c, "[^0-9]"),
        "hex_only": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": flag(c.rlike("^[0-9]+$")),
        "uuid": flag(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "dictionary_share": 1 - gone(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))) / n,
        "repeat_share": 1 - F.length(F.regexp_replace(c, r"(.{1,4})\1+", "$1")) / n,
        "for_before": flag(before.rlike(FOR_WORDS)),
        "against_around": flag(around.rlike(AGAINST_WORDS)),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")),
        "path_for": flag(path.rlike(PATH_FOR)),
        "path_against": flag(path.rlike(PATH_AGAINST)),
    })
    return rows.drop("_kind", "_sound")


def labelled_findings(spark: SparkSession, n: int = TRAINING_ROWS, seed: int = 11) -> DataFrame:
    """(doc_id, text, path, label): generated findings of known truth, made with DataFrame functions from row numbers."""
    h = lambda *k: F.xxhash64(F.lit(seed), "id", *[F.lit(x) for x in k])
    pick = lambda key, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(h(key), F.lit(len(words))) + 1).cast("int"))
    hexa = F.concat(F.sha2(h("hex").cast("string"), 256), F.sha2(h("hex2").cast("string"), 256))
    base = F.base64(F.unhex(F.sha2(h("b64").cast("string"), 512)))
    mixed = F.regexp_replace(base, "[+/=]", "")
    size = lambda key, lo, hi: (F.pmod(h(key), F.lit(hi - lo)) + lo).cast("int")
    words = lambda key, sep: F.concat_ws(sep, *[pick(f"{key}{i}", DICTIONARY) for i in range(4)])
    real = F.array(F.left(hexa, size("l1", 32, 65)), F.left(hexa, F.lit(40)), F.upper(F.left(hexa, F.lit(40))), F.left(base, size("l2", 24, 65)), F.concat(pick("p", ["sk_live_", "ghp_", "AKIA", "xoxb-", "glpat-", "key-"]), F.left(mixed, size("l3", 20, 41))), F.left(mixed, size("l4", 18, 41)))
    false = F.array(
        F.left(hexa, F.lit(40)), F.left(hexa, F.lit(32)), F.regexp_replace(F.left(hexa, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.regexp_replace(F.left(F.conv(F.left(hexa, F.lit(15)), 16, 10), F.lit(18)), "^0", "4"),
        words("w", "_"), words("w", ""), words("w", "-"), words("w", "/"), F.concat(words("w", "-"), F.lit("-"), F.pmod(h("year"), F.lit(3000)).cast("string")), F.repeat(pick("r", ["x", "0", "abcd", "1234", "=", "-", "_"]), 20), F.concat(F.lit("your_"), pick("y", ["api_key", "secret", "token", "access_key"]), F.lit("_here_please")),
        F.initcap(words("w", "")), F.regexp_replace(F.translate(F.left(hexa, F.lit(30)), "0123456789abcdef", "aeiouthernlsadic"), "[0-9]", "o"),
    )
    name = pick("n", ["token", "TOKEN", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "credentials"])
    plain = pick("m", ["commit", "sha1", "md5 checksum", "id", "uuid", "see", "order", "build", "file", "etag", "the word", "and", "from"])
    sign = pick("s", [" = \"", "=\"", ": '", "=", ": ", " = "])
    end = F.when(F.instr(sign, "\"") > 0, "\"").when(F.instr(sign, "'") > 0, "'").otherwise("")
    truth = F.pmod(h("truth"), F.lit(2)) == 1
    body = F.when(truth, F.element_at(real, (F.pmod(h("kind"), F.lit(6)) + 1).cast("int"))).otherwise(F.element_at(false, (F.pmod(h("kind"), F.lit(13)) + 1).cast("int")))
    # a secret mostly has its name before it; a harmless value has one now and then, but not if it looks just like a secret
    lookalike = F.pmod(h("kind"), F.lit(13)) < 4
    named = F.when(truth, F.pmod(h("named"), F.lit(10)) < 9).otherwise(~lookalike & (F.pmod(h("named"), F.lit(10)) < 4))
    lead = F.when(named, F.concat(words("a", " "), F.lit(" "), name, sign)).when(truth, F.concat(words("a", " "), F.lit(" "), pick("o", ["use", "with", "export", "header"]), F.lit(" "))).otherwise(F.concat(words("a", " "), F.lit(" "), plain, F.lit(" ")))
    path = F.when(truth, pick("path", ["src/config.yml", ".env", "deploy/settings.py", "app/main.py", "src3", "src17", ""])).otherwise(pick("path", ["tests/test_api.py", "docs/example.md", "CHANGELOG", "yarn.lock", "app/main.py", "src3", "src17", ""]))
    text = F.concat(lead, body, F.when(named, end).otherwise(""), F.lit(" "), words("z", " "))
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), path.alias("path"), truth.cast("int").alias("label"), F.length(lead).alias("at"))


def fitted(spark: SparkSession, labelled: DataFrame | None = None, most: int = TRAINING_ROWS, size: forest.ForestSize = forest.ForestSize()) -> list:
    """The forest of labelled findings (doc_id, text, path, label, at); at most ``most`` of them are gathered."""
    labelled = labelled_findings(spark, most) if labelled is None else labelled
    rows = described(candidates(labelled)).where("start = at").select(*FEATURES, "label").limit(most).collect()
    table = np.array([[float(v) for v in r] for r in rows])
    return forest.fit(table[:, :-1], table[:, -1], size)


def secret_scan(docs: DataFrame, trees: list | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, start, length, secret, before, score) of every candidate that the forest takes for a secret."""
    trees = fitted(docs.sparkSession) if trees is None else trees
    rows = described(candidates(narrowed(docs, doc_id=id_col, text=text_col, path=path_col)))
    # letters directly before "=" are the name of a value, not one
    rows = rows.where(~(F.col("secret").rlike("^[A-Za-z_]+$") & F.col("after").startswith("=")))
    # the features become a table of their own, so that the forest's many branches don't copy their expressions
    table = rows.select("doc_id", "start", "secret", "before", F.struct(*FEATURES).alias("x"))
    score = F.expr(forest.to_sql(trees, [f"x`.`{f}" for f in FEATURES]))
    return table.withColumn("score", score).where(F.col("score") >= threshold).select("doc_id", "start", F.length("secret").alias("length"), "secret", "before", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; the secret itself is given as a digest."""
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"), F.sha2("secret", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
