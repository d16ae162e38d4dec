"""Operator 2: secret scans with a random forest that removes false positives.

Candidates are long runs of key characters, and shorter values beside the names of secrets. Their features are length, transitions between kinds of characters, how much
of them dictionary words cover, the path they stand in, and the words beside them. A random forest, trained from
labelled findings, gives each a score. Only DataFrame operations and Spark's own learner run.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpointed, read_table

MIN_LENGTH = 16
BEFORE, AFTER = 48, 24
#: A long run of key characters; or, right after the name of a secret and a colon or an equals sign, any value of six characters or more.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])"
STOP = r"\s\"'`,;&<>()\[\]{}"
NAMED = r"(?i:secret|token|passw(?:or)?d|passphrase|passwd|api[ _-]?key|auth|authorization|credential|private|access[ _-]?key|client[ _-]?key|private[ _-]?key|pwd)"
VALUE = rf"(?<=[:=][\"'`]|[:=]|[:=]\s{{1,3}}|[:=]\s{{1,3}}[\"'`])(?<={NAMED}[\"'`]?\s{{0,3}}:?[:=]\s{{0,3}}[\"'`]?)[^{STOP}=:][^{STOP}]{{4,}}[^{STOP}.:](?=[.:]?(?:[{STOP}]|$))"
TOKEN = f"{RUN}|{VALUE}"
#: Formats of known issuers.
ISSUED = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}|glpat-[A-Za-z0-9_-]{20,})"
#: Words of names and code: what they cover is no random text.
DICTIONARY = "account|action|address|admin|always|application|array|before|between|block|boolean|bucket|button|cache|class|client|code|collection|column|component|config|connection|container|content|control|count|create|data|default|description|document|download|element|error|event|example|export|field|file|filter|format|function|general|global|group|handler|image|import|index|input|instance|integer|interface|item|language|length|library|license|list|local|manager|master|message|method|model|module|name|network|node|number|object|option|order|output|package|page|param|parent|parse|path|pattern|pipeline|plugin|point|position|process|product|project|property|provider|query|queue|record|reference|release|remote|report|request|resource|response|result|return|sample|schema|script|search|section|select|server|service|session|setting|size|source|stage|state|static|status|storage|stream|string|style|switch|system|table|target|template|test|text|thread|time|title|type|update|user|value|version|view|widget|window|with|worker|the|and|ing|tion"
SECRET_WORDS = r"(?i)(?:secret|token|passw(?:or)?d|passwd|api[ _-]?key|apikey|auth|bearer|credential|private|access[ _-]?key|client[ _-]?key|\bkey\b|\bpwd\b)"
HARMLESS_WORDS = r"(?i)(?:commit|sha-?1|sha-?256|sha-?512|md5|checksum|digest|hash|uuid|guid|revision|version|etag|integrity|example|sample|dummy|placeholder|changeset|blob|build|fingerprint|order|invoice|ticket|isbn|\bid\b)"
FEATURES = ("length", "digits", "upper", "lower", "marks", "hex", "distinct", "change", "letter_digit", "digit_letter", "case_up", "vowel_consonant", "repeats", "dictionary", "issued", "in_path", "in_url", "file_name", "secret_near", "harmless_near", "assigned", "quoted", "word_before", "word_after")
#: Labelled findings are taken up to this number, in the order of a hash.
MAX_FINDINGS = 20_000
TREES, DEPTH, SEED = 24, 7, 2026
THRESHOLD = 0.5


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start (characters before it), token, before, after: every candidate of docs (doc_id, text)."""
    long_enough = F.col("text").rlike(TOKEN)
    rows = docs.select("doc_id", "text").filter(long_enough).withColumn("rid", F.monotonically_increasing_id())
    gaps, tokens = F.split("text", TOKEN, -1), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    rows = rows.select("doc_id", "rid", gaps.alias("gaps"), tokens.alias("tokens"))
    # Of a gap only its length and its ends go on.
    ends = F.transform("gaps", lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(BEFORE)).alias("tail"), F.left(g, F.lit(AFTER)).alias("head")))
    rows = rows.withColumn("ends", ends).select("doc_id", "rid", F.arrays_zip(F.slice("ends", F.lit(1), F.size("tokens")).alias("left"), F.slice("ends", F.lit(2), F.size("tokens")).alias("right"), F.col("tokens").alias("token")).alias("found"))
    rows = rows.select("doc_id", "rid", F.posexplode("found").alias("k", "f"))
    size = F.col("f.left.n") + F.length("f.token")
    upto = F.sum(size).over(W.partitionBy("rid").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("start", (upto - F.length("f.token")).cast("long"))
    return rows.select("doc_id", "start", F.col("f.token").alias("token"), F.col("f.left.tail").alias("before"), F.col("f.right.head").alias("after"))


def share(pattern: str, of: str = "token") -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.length(of)


def with_features(found: DataFrame) -> DataFrame:
    """found (token, before, after) with the columns of FEATURES."""
    near = F.concat_ws(" ", F.right("before", F.lit(32)), F.left("after", F.lit(8)))
    flag = lambda c: c.cast("double")
    made = {
        "length": F.log2(F.length("token")), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "marks": share("[^A-Za-z0-9]"), "hex": flag(F.col("token").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct": F.size(F.array_distinct(F.split("token", ""))) / F.least(F.length("token"), F.lit(64)),
        "change": share(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"), "letter_digit": share(r"(?<=[A-Za-z])(?=[0-9])"), "digit_letter": share(r"(?<=[0-9])(?=[A-Za-z])"), "case_up": share(r"(?<=[a-z])(?=[A-Z])"),
        "vowel_consonant": share(r"(?i)(?<=[aeiouy])(?=[b-df-hj-np-tv-xz])"), "repeats": share(r"(.)(?=\1)"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower("token"), DICTIONARY, "")) / F.length("token"),
        "issued": flag(F.col("token").rlike(ISSUED)), "in_path": flag(F.col("token").rlike("/.*/") | F.col("before").rlike(r"[/\\]$")), "in_url": flag(F.col("before").rlike(r"(?i)(?:https?://|www\.)\S*$")),
        "file_name": flag(F.col("after").rlike(r"^\.[a-z]{2,5}\b") | F.col("before").rlike(r"[\w-]\.$")), "secret_near": flag(near.rlike(SECRET_WORDS)), "harmless_near": flag(near.rlike(HARMLESS_WORDS)),
        "assigned": flag(F.col("before").rlike(r"""[:=]\s*["'`]?$""")), "quoted": flag(F.col("before").rlike("""["'`]$""")), "word_before": flag(F.col("before").rlike(r"[A-Za-z]{2,}[ ,.]+$")), "word_after": flag(F.col("after").rlike(r"^[ ,.]+[A-Za-z]{2,}")),
    }
    names = list(FEATURES)
    half = found.withColumns({f: made[f].cast("double") for f in names[:14]})
    # All in one projection are more than compiled code holds; the second half begins behind a generator, across which Spark merges none.
    apart = half.select(F.inline(F.array(F.struct(*half.columns))))
    return apart.withColumns({f: made[f].cast("double") for f in names[14:]})


def example_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n invented labelled findings (token, before, after, label): keys of several formats as they are handed out, and what looks like them.

    Made from hashes of the row number, so every run has the same ones. For findings of one's own, pass those.
    """
    h = lambda salt: F.sha2(F.concat_ws("|", F.lit(salt), F.col("id").cast("string")), 512)
    pick = lambda salt, values: F.element_at(F.split(F.lit("\x01".join(map(str, values))), "\x01", -1), (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col("id").cast("string"))), 1, 6), 16, 10).cast("int") % len(values) + 1))
    alnum = F.regexp_replace(F.concat(F.base64(F.unhex(h("a"))), F.base64(F.unhex(h("b")))), "[+/=]", "")
    words = [w for w in DICTIONARY.split("|") if len(w) > 4]
    some = F.concat_ws(" ", pick("x", words), pick("y", words))
    camel = F.concat(pick("c1", words), F.initcap(pick("c2", words)), F.initcap(pick("c3", words)), pick("c4", ["", "2", "V3", "64"]))
    hexes = lambda salt: F.substr(h(salt), F.lit(1), pick("n" + salt, [32, 40, 40, 64]).cast("int"))
    secret_names = pick("name", ["token", "secret", "password", "api_key", "API_KEY", "auth_token", "access_key", "client_secret", "passwd", "Authorization", "private key"])
    assign = pick("op", [' = "', "=", ": ", ': "', " := '", '="', "='"])
    end = pick("end", ['" ', "' ", " ", '", ', '"\n', "; "])
    yes = [  # token, before
        (hexes("h1"), F.concat(some, F.lit(" "), secret_names, assign)),
        (F.substr(alnum, F.lit(1), pick("len", [20, 24, 32, 40, 48, 64]).cast("int")), F.concat(some, F.lit(" "), secret_names, assign)),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(h("k"), 1, 16))), F.concat(some, pick("o2", [" ", " = ", ': "', "="]))),
        (F.concat(pick("gh", ["ghp_", "gho_", "sk_live_", "glpat-", "xoxb-"]), F.substr(alnum, F.lit(1), F.lit(36))), F.concat(some, pick("o3", [" ", " = ", ': "', "Bearer "]))),
        (F.concat(F.lit("eyJ"), F.substr(alnum, F.lit(1), F.lit(60))), F.concat(some, pick("o4", [" Bearer ", ' token: "', " jwt="]))),
        (F.concat(F.base64(F.unhex(F.substring(h("b64"), 1, 64)))), F.concat(some, F.lit(" "), secret_names, assign)),
        (F.substr(F.regexp_replace(alnum, "[0-9]", ""), F.lit(1), pick("len2", [16, 20, 24, 32]).cast("int")), F.concat(some, F.lit(" "), secret_names, assign)),
        (F.substr(alnum, F.lit(1), pick("len3", [8, 10, 12, 14]).cast("int")), F.concat(some, F.lit(" "), secret_names, assign)),
        (F.concat(F.initcap(F.substring(pick("pw", words), 1, 8)), pick("pn", ["7", "42", "2024", "123", "99"]), pick("pm", ["!", "$", "#", "?", ""])), F.concat(some, F.lit(" "), secret_names, assign)),
    ]
    no = [
        (hexes("h2"), F.concat(some, pick("w1", [" commit ", " sha256:", " md5 ", " checksum: ", " revision ", " hash = ", " digest=", " integrity ", ' "sha1": "', " fingerprint "]))),
        (F.concat_ws("-", *[F.substring(h("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.concat(some, pick("w2", [" uuid ", " id=", " ", ' guid: "', " request "]))),
        (F.concat(camel, pick("t", ["1", "22", "2024"])), F.concat(some, pick("w3", [" ", ".", " = ", "/"]))),
        (F.concat_ws("/", pick("p1", words), pick("p2", words), F.concat(pick("p3", words), F.lit("2"))), F.concat(some, pick("w4", [" ", " https://host.example/", " /", " path = "]))),
        (F.concat_ws("_", pick("p5", words), pick("p6", words), F.concat(pick("p7", words), F.lit("01"))), F.concat(some, pick("w5", [" ", " = ", " secret ", " token "]))),
        (F.regexp_replace(F.substring(h("n"), 1, 40), "[a-f]", "7"), F.concat(some, pick("w6", [" ", " order ", " invoice ", " number ", " id "]))),
        (F.substring(pick("z", ["xxxxxxxxxxxxxxxxxxxxxxxx1234", "your-api-key-goes-here-1234", "0000000000000000000000000000", "1234567890abcdef1234567890abcdef", "changeme-changeme-123", "EXAMPLE0KEY0EXAMPLE0KEY"]), 1, 40), F.concat(some, F.lit(" "), secret_names, assign)),
        (F.concat_ws("-", pick("q1", words), pick("q2", words), pick("q3", words), F.lit("2024")), F.concat(some, pick("w7", [" https://www.example.org/blog/", " /", " "]))),
        (pick("v1", [w for w in words if len(w) > 5]), F.concat(some, F.lit(" "), secret_names, pick("o5", [": ", " = ", "="]))),
        (camel, F.concat(some, pick("w8", [" ", ".", " = ", " token = ", "/"]))),
        (F.concat(pick("l1", words), pick("l2", words), pick("l3", words)), F.concat(some, pick("w9", [" ", " the ", ", "]))),
        (F.concat(pick("r1", words), pick("j", ["-", "_", "/"]), pick("r2", words), pick("j", ["-", "_", "/"]), pick("r3", words)), F.concat(some, pick("wa", [" ", " /", " = ", " key = "]))),
    ]
    rows = yes * 4 + no * 3  # 36 of each
    what = F.array(*[F.struct(t.alias("token"), b.alias("before"), F.lit(float(i < len(yes) * 4)).alias("label")) for i, (t, b) in enumerate(rows)])
    rows_df = spark.range(0, n, 1, 4).withColumn("w", F.element_at(what, (F.col("id") % len(rows) + 1).cast("int")))
    return rows_df.select("w.token", "w.before", F.concat(end, pick("after", words)).alias("after"), "w.label")


def train(findings: DataFrame, max_findings: int = MAX_FINDINGS) -> RandomForestClassificationModel:
    """The forest of labelled findings (token, before, after, label 0 or 1); beyond max_findings those with the least hashes. Nulls count as empty texts."""
    rows = findings.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("token", "before", "after")], F.col("label").cast("double").alias("label")).filter("token != '' AND label IS NOT NULL")
    # Written, as the learner reads its rows again and again: else each time the driver plans and compiles all that they are made of.
    rows = checkpointed(rows.orderBy(F.xxhash64("token", "before", "after"), "token", "before", "after").limit(max_findings))
    made = checkpointed(with_features(rows).select(*FEATURES, "label"))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(ready)


_forests: dict[str, RandomForestClassificationModel] = {}


def example_forest(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest of example_findings, which is always the same; an application trains it once."""
    own = spark.sparkContext.applicationId
    if own not in _forests:
        _forests[own] = train(example_findings(spark))
    return _forests[own]


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, token, before, after, score and is_secret: every candidate of docs (doc_id, text) with the forest's verdict.

    start counts characters. Null and empty texts have no candidates; a null doc_id stays null; repeated rows give
    repeated findings; other columns are ignored; an empty table gives an empty one. Texts and tokens are whole.
    model: by default example_forest.
    """
    model = model or example_forest(docs.sparkSession)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs)))
    out = model.setProbabilityCol("probability").transform(ready)
    score = vector_to_array("probability")[1]
    return out.select("doc_id", "start", "token", "before", "after", F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates in documents, as spans and hashes, with scores and verdicts."""
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("token").alias("length"), F.sha2("token", 256).alias("token_sha256"), "score", "is_secret")
