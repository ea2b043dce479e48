"""Secret scanning with a random forest that removes false positives, in DataFrame functions alone.

A pattern finds candidates: long runs of key letters that hold a digit, values set to a name like "password" (in any case,
with or without quotes), passwords in URLs, and private keys up to their END line, of which the header is judged. For each the features are measured: length, kinds of characters and their transitions, distinct
characters, coverage by dictionary words, path signs, and neighbouring words. A random forest, trained here on labelled
findings (made by rule, ``FINDINGS`` of them), tells secrets from ids, digests, paths, names and placeholders. The forest is
turned into one SQL expression, so that a document is scanned, judged and redacted where it is read: nothing is
shuffled, and long documents and hot sources cost what their bytes cost.

Defined results: null and empty texts have no findings; a null text stays null when redacted; every occurrence is a finding, also in
rows that repeat; extra columns pass through ``redacted`` unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_prefix

FINDINGS = 4000
TREES = 15
DEPTH = 6
THRESHOLD = 0.5
FOLD = 256  # candidates added up at once
BEFORE, AFTER = 48, 24  # characters of context
MARK = "[SECRET]"

NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|credentials?)"
VALUE = r"A-Za-z0-9!@#$%^&*+/_-"
HEADER = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
# a key comes first, so that a name before it doesn't take its first word; short checks stand before the long ones behind, which would be tried at every place
CANDIDATE = (
    rf"{HEADER}(?:[\s\S]{{0,16384}}?-----END [A-Z ]{{0,20}}PRIVATE KEY-----)?+"
    rf"|(?<=[=:]\s{{0,2}}[\"']?)(?=[.{VALUE}]{{8}})(?<={NAMED}[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[.{VALUE}]{{7,}}[{VALUE}]={{0,2}}+"
    r"|(?<=:)(?=[^\s/@:]{3,128}@)(?<=://[^\s/:@]{0,64}:)[^\s/@:]{3,128}+"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
)
# Words that prose, names and paths are made of, words beside secrets, and words beside other long strings.
DICTIONARY = "the|and|ing|tion|user|file|name|path|home|data|test|page|index|image|config|version|release|report|chapter|section|figure|table|model|server|client|number|order|product|article|summer|winter|online|update|service|system|project|module|package|document|download|content|default|example|sample|placeholder|password|change"
NEAR_SECRET = r"(?i)(pass|pwd|secret|token|api.?key|access|credential|auth|private)"
NEAR_OTHER = r"(?i)(commit|sha|md5|digest|checksum|hash|uuid|guid|etag|isbn|doi|version|rev\b|build|order|tracking|invoice|session.?id|trace)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|your|changeme|xxxx|test|fake|redacted|0000000|1234567|abcdef)"
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|xox[bap]-|sk-|sk_live|AIza|glpat-|eyJ|-----BEGIN)"

FEATURES = {
    "length": "length(c)",
    "digits": "regexp_count(c, '[0-9]') / length(c)",
    "upper": "regexp_count(c, '[A-Z]') / length(c)",
    "lower": "regexp_count(c, '[a-z]') / length(c)",
    "signs": "regexp_count(c, '[^A-Za-z0-9]') / length(c)",
    "hex": "cast(c rlike '^([0-9a-f]+|[0-9A-F]+)$' as double)",
    "turns": "regexp_count(c, '[a-z](?=[0-9A-Z])|[A-Z](?=[0-9a-z])|[0-9](?=[A-Za-z])') / length(c)",
    "runs": "regexp_count(c, '(.)(?=\\\\1)') / length(c)",
    "vowels": "regexp_count(c, '[aeiouAEIOU]') / greatest(1, regexp_count(c, '[A-Za-z]'))",
    "distinct": "cast(array_size(array_distinct(split(c, ''))) as double) / least(length(c), 36)",
    "words": f"1 - length(regexp_replace(lower(c), '({DICTIONARY})', '')) / length(c)",
    "path": "regexp_count(c, '/') + cast(l rlike '[/.\\\\\\\\]$' as int) * 2",
    "dashes": "regexp_count(c, '-')",
    "set": "cast(l rlike '[=:]\\\\s?[\"\\']?$' as double)",
    "near_secret": f"cast(l rlike '{NEAR_SECRET}[^ ]{{0,12}}\\\\s?[=:]?\\\\s?[\"\\']?(is )?$' as double)".replace("\\b", "\\\\b"),
    "near_other": f"cast(right(l, 24) rlike '{NEAR_OTHER}' as double)".replace("\\b", "\\\\b"),
    "placeholder": f"cast(concat(c, ' ', right(l, 12), ' ', left(r, 8)) rlike '{PLACEHOLDER}' as double)",
    "user_info": "cast(l rlike '://[^ /:@]{0,64}:$' and r rlike '^@' as double)",
    "prefix": f"cast(c rlike '{PREFIX}' as double)",
}


def _feature_sql(c: str, left: str, right: str) -> dict[str, str]:
    """The features' SQL for a candidate and what stands before and after it."""
    swap = {"c": c, "l": left, "r": right}
    quoted = re.compile(r"""('(?:[^'\\]|\\.)*')""")
    # only bare c, l and r stand for the candidate and its context; what is quoted stays
    fill = lambda v: "".join(p if i % 2 else re.sub(r"\b[clr]\b", lambda m: swap[m[0]], p) for i, p in enumerate(quoted.split(v)))
    return {k: f"cast({fill(v)} as double)" for k, v in FEATURES.items()}


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Findings (c, l, r, label) of a dozen kinds, made by rule from digests of their numbers."""
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("i").cast("string")), 256)
    upper = F.upper(F.translate(F.concat(h("u"), h("v")), "0123456789abcdef", "Q7ZK2XWJ9RTYAPLM"))
    mixed = F.translate(F.concat(F.substring(h("m"), 1, 24), F.upper(F.substring(h("n"), 1, 24))), "0369adADBE", "xGqTzKvHw7")
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in DICTIONARY.split("|")]), (F.pmod(F.xxhash64("i", F.lit(k)), F.lit(DICTIONARY.count("|"))) + 1).cast("int"))
    number = lambda k, size: F.substring(F.regexp_replace(F.concat(h(k), h(k + "x")), "[a-f]", ""), 1, size)
    size = lambda lo, hi: (F.pmod(F.xxhash64("i", F.lit("size")), F.lit(hi - lo + 1)) + lo).cast("int")
    cut = lambda x, lo, hi: F.substr(x, F.lit(1), size(lo, hi))
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.pmod(F.xxhash64("i", F.lit("pick")), F.lit(len(x))) + 1).cast("int"))
    kinds = [
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), pick("in the onst ", "key: ", "of and er ", ""), F.lit(" and")),
        (1, cut(h("p"), 16, 32), pick("and password=", "login passwd=", "secret: ", "pass = \""), pick(" the", "\"", "")),
        (1, F.substring(h("t"), 1, 40), pick("stat token = \"", "api_key: ", "token=", "auth_token = '"), pick("\" in", "'", "")),
        (1, F.concat(pick("ghp_", "sk-", "glpat-", "AIza"), cut(mixed, 30, 40)), pick("use ", "export X=", "the ", "key "), F.lit(" ")),
        (1, cut(mixed, 20, 44), pick("secret_key = ", "access token: ", "password: ", "credentials="), F.lit(" ")),
        (1, F.concat(F.substring(mixed, 1, 9), pick("!", "#", "")), pick("password=", "secret:", "token="), F.lit(" ")),
        (1, F.concat(F.substring(mixed, 1, 4), pick("!", "&", "-", "x", "3"), F.substring(mixed, 8, 5)), pick("DB_PASSWORD=", "and PASSWORD=", "pwd=", "Token=", "password: ", "password=\"", "\"password\": \"", "credential: '"), pick(" ", "\"", "\n", "")),
        (1, cut(F.translate(F.concat(h("e"), h("f")), "0123456789abcdef", "qwertyuiopzdxghk"), 14, 30), pick("token: \"", "secret = \"", "pwd: ", "api_key=", "password=\""), pick("\"", " ", "")),
        (1, cut(mixed, 6, 16), pick("https://user:", "postgres://admin:", "see ftp://u1:", "mysql://root:"), pick("@host/", "@db.local:5432/x", "@10.0.0.1 and")),
        (1, F.lit("-----BEGIN RSA PRIVATE KEY-----"), pick("", "key\n", "of the "), F.lit("\n")),
        (0, F.substring(h("g"), 1, 40), pick("in commit ", "sha1 ", "rev ", "checksum: ", "digest "), F.lit(" and")),
        (0, F.substring(h("d"), 1, pick(32, 64)), pick("md5: ", "sha256 ", "etag ", "hash of the file "), F.lit(" ")),
        (0, F.concat_ws("-", F.substring(h("a"), 1, 8), F.substring(h("a"), 9, 4), F.substring(h("a"), 13, 4), F.substring(h("a"), 17, 4), F.substring(h("a"), 21, 12)), pick("uuid ", "id: ", "the ", "trace "), F.lit(" ")),
        (0, F.concat_ws("-", word(1), word(2), word(3), number("s", 4)), pick("see ", "/", "of the ", "."), F.lit(".")),
        (0, F.concat_ws("/", word(4), word(5), word(6), F.concat(word(7), number("q", 2))), pick("/", "in ", "http:/"), F.lit(".")),
        (0, F.concat(word(13), word(14)), pick("secret: ", "password: ", "the token = ", "Password: ", "credentials: ", "\"token\": \""), pick(" ", ".", " and", "\"")),
        (0, F.concat(F.initcap(word(8)), F.initcap(word(9)), F.initcap(word(10)), number("c", 2)), pick("call ", "the ", "class "), F.lit("(")),
        (0, cut(number("w", 30), 16, 20), pick("number ", "de ", "| ", "the "), F.lit(" ")),
        (0, F.concat(pick("AKIA", "AKIAIOSFODNN"), pick("EXAMPLE0", "7EXAMPLE", "XXXX0000XXXX")), pick("like ", "key: ", "password="), F.lit(" ")),
        (0, pick("your_password_here1", "changeme12345678", "xxxxxxxxxxxxxxx1", "placeholder00001", "test_token_123456", "0000000000000000"), pick("password=", "token = \"", "secret: ", "the "), pick(" ", "\"")),
        (0, F.concat(word(11), F.lit("_"), word(12), F.lit("_v"), number("z", 1), F.lit("_"), number("y", 8)), pick("file ", "build ", "the ", "/"), F.lit(".")),
        (0, F.concat(number("y", 4), F.lit("-"), number("k", 2), F.lit("-"), number("l", 2), F.lit("T"), number("o", 6)), pick("at ", "on ", "| "), F.lit("Z")),
    ]
    rows = None
    for k, (label, c, left, right) in enumerate(kinds):
        own = spark.range(k * n, k * n + n // len(kinds), 1, 1).withColumnRenamed("id", "i").select(c.alias("c"), left.alias("l"), right.alias("r"), F.lit(float(label)).alias("label"))
        rows = own if rows is None else rows.union(own)
    return rows.coalesce(1)


_models: dict[str, RandomForestClassificationModel] = {}


def forest(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest, trained once for each application."""
    key = spark.sparkContext.applicationId
    if key not in _models:
        found = labelled_findings(spark).select("label", *[F.expr(v).alias(k) for k, v in _feature_sql("c", "l", "r").items()])
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found).select("label", "features")
        _models.clear()
        _models[key] = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=48, seed=5, featureSubsetStrategy="sqrt").fit(rows)
    return _models[key]


def _tree_sql(node, names: list[str]) -> str:
    """A tree of the forest as nested CASE expressions over fields of f."""
    if node.numDescendants() == 0:
        counts = list(node.impurityStats().stats())
        return repr(counts[1] / max(sum(counts), 1e-9)) + "D"
    split = node.split()
    return f"CASE WHEN f.{names[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


def forest_sql(model: RandomForestClassificationModel) -> str:
    """The forest's probability of a secret, over a struct f of features."""
    trees = [_tree_sql(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode(), list(FEATURES)) for t in model.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}D"


def _scanned(df: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """df with a column found: for each candidate its text, score, and the text before it since the last candidate; and with tail.

    The names begin with what comes second, so that they clash with no column of df.
    """
    own = free_prefix(df)
    pattern = F.lit(CANDIDATE)
    probability = forest_sql(forest(df.sparkSession))
    text = F.col(f"`{text_col}`")
    # only texts with a candidate are taken apart; gaps are what stands around candidates
    parts = df.withColumn(f"{own}has", F.coalesce(text.rlike(CANDIDATE), F.lit(False)))
    c, g = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, CANDIDATE, -1)
    parts = parts.withColumn(f"{own}p", F.when(F.col(f"{own}has"), F.struct(c.alias("c"), g.alias("g"))))
    gaps = f"slice({own}p.g, {{0}}, size({own}p.c))"
    zipped = f"arrays_zip({own}p.c, {gaps.format(1)}, {gaps.format(2)})"
    parts = parts.withColumn(f"{own}a", F.expr(f"transform({zipped}, x -> named_struct('c', x.c, 'h', if(x.c rlike '^{HEADER}', regexp_extract(x.c, '^{HEADER}', 0), x.c), 'gap', x.`1`, 'l', right(x.`1`, {BEFORE}), 'r', left(x.`2`, {AFTER})))"))
    struct = ", ".join(f"'{k}', {v}" for k, v in _feature_sql("x.h", "x.l", "x.r").items())
    scored = f"transform(transform({own}a, x -> named_struct('c', x.c, 'gap', x.gap, 'f', named_struct({struct}))), y -> named_struct('c', y.c, 'gap', y.gap, 'score', {probability.replace('f.', 'y.f.')}))"
    return parts.withColumn(f"{own}found", F.expr(scored)).withColumn(f"{own}tail", F.element_at(f"{own}p.g", -1)).drop(f"{own}a", f"{own}p"), own


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, start, length, kind, score, secret_sha256) of every secret; start counts characters from 0."""
    found, own = _scanned(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    # places: the lengths of all that stands before, added up along the text, block by block, so that no step copies a long array
    empty = "cast(array() as array<struct<start:bigint,c:string,score:double>>)"
    item = "named_struct('start', b.at + length(y.gap), 'c', y.c, 'score', y.score)"
    step = f"named_struct('at', b.at + length(y.gap) + length(y.c), 'all', if(y.score >= {threshold}, array_append(b.all, {item}), b.all))"
    block = f"aggregate(slice({own}found, i * {FOLD} + 1, {FOLD}), named_struct('at', a.at, 'all', {empty}), (b, y) -> {step}, b -> named_struct('at', b.at, 'all', array_append(a.all, b.all)))"
    start = "named_struct('at', 0L, 'all', cast(array() as array<array<struct<start:bigint,c:string,score:double>>>))"
    placed = f"aggregate(sequence(0, int((size({own}found) - 1) / {FOLD})), {start}, (a, i) -> {block}, a -> flatten(a.all))"
    rows = found.where(f"{own}has").select("id", F.explode(F.expr(placed)).alias("x")).select("id", "x.start", "x.c", "x.score")
    kind = F.when(F.col("c").rlike(f"^{HEADER}"), "private key").when(F.col("c").rlike(PREFIX), "known prefix").when(F.col("c").rlike("^[0-9a-f]+$"), "hex").otherwise("other")
    return rows.select("id", "start", F.length("c").cast("long").alias("length"), kind.alias("kind"), "score", F.sha2("c", 256).alias("secret_sha256"))


def redacted(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with every secret in the text replaced by MARK."""
    found, own = _scanned(df, text_col)
    body = F.expr(f"concat(array_join(transform({own}found, y -> concat(y.gap, if(y.score >= {threshold}, '{MARK}', y.c))), ''), {own}tail)")
    text = F.when(F.col(f"{own}found").isNotNull(), body).otherwise(F.col(f"`{text_col}`"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
