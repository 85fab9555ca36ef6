"""Secrets in texts: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

The forest is trained from labelled findings (by default those of :func:`labelled_findings`) and compiled into SQL
expressions, so scoring stays inside the query's own code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEFORE, AFTER = 48, 24
REDACTED = "[SECRET]"
#: Words that name a secret, and words that name another kind of number.
SECRET_WORDS = "token|secret|password|passwd|pwd|api[ _-]?key|apikey|access[ _-]?key|auth|authorization|bearer|credential|private[ _-]?key|signing[ _-]?key"
OTHER_WORDS = "commit|revision|rev|sha1|sha256|md5|digest|checksum|hash|etag|uuid|guid|integrity|version|build|order|invoice|isbn|phone|card|serial|example|sample"
#: Words of the dictionary whose share of a candidate is measured.
DICTIONARY = (
    "the|and|for|with|test|example|sample|dummy|your|here|change|placeholder|lorem|ipsum|index|static|assets|content|image|images|node|modules|package|version|build|release|default|config|file|files|path|page|user|users|name|data|main|lib|usr|local|home|http|https|www|html|json|yaml|java|python|spark"
    "|password|secret|token|apikey|key|value|string|number|insert|replace|required|optional|enabled|disabled|settings|options|service|server|client|account|manager|factory|handler|request|response|message|object|array|list|get|set|from|this|that|private|public|access|redacted|hidden|none|null|undefined|true|false"
)
#: Letter pairs that are frequent in prose of English, German, French and Spanish.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|ei|ie|un|ge|ic|sc|ht|da|di|ck|ke|ig|qu|ue|ai|el|la|em|eu|tr|pa|ux|au|os|do|ad|ci|aj|ie|lo|us|ta|ct|ss|tu|po|su|ent|nte"
#: Characters of keys; Java's possessive quantifiers, so that nothing is tried twice.
KEY = r"[A-Za-z0-9+/_\-]"
#: Whole runs of at least 16 key characters, however long, and of 8 to 15 where a secret is named and assigned before them.
CANDIDATE = rf"(?<!{KEY})(?:{KEY}{{16,}}+|(?={KEY}{{8}})(?<=(?i:{SECRET_WORDS})[\"'\]]{{0,2}}\s{{0,3}}(?:[:=]|:=|=>)\s{{0,3}}[\"'`]?){KEY}{{8,15}}+)={{0,2}}"
#: Candidates whose lengths are summed at once, so that a text of many takes no quadratic time.
CHUNK = 256
FEATURES = ["n_chars", "digits", "uppers", "lowers", "marks", "changes", "distinct", "hex", "longest_run", "dictionary", "pairs", "slashes", "path_before", "secret_word", "other_word", "assigned", "quoted", "sentence_after"]


def features(rows: DataFrame) -> DataFrame:
    """Columns FEATURES of ``candidate`` with what stands ``before`` and ``after`` it."""
    c, before, after = F.col("candidate"), F.lower("before"), F.col("after")
    n = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    left = lambda pattern: 1 - F.length(F.regexp_replace(F.lower(c), pattern, "")) / n
    truth = lambda x: x.cast("double")
    return rows.select(
        "*",
        n.cast("double").alias("n_chars"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[a-z]").alias("lowers"),
        share(r"[+/_\-=]").alias("marks"),
        share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]").alias("changes"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        truth(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        (F.array_max(F.transform(F.regexp_extract_all(c, F.lit("([a-z]+|[A-Z]+|[0-9]+)"), F.lit(1)), lambda x: F.length(x))) / n).alias("longest_run"),
        left(DICTIONARY).alias("dictionary"),
        left(PAIRS).alias("pairs"),
        (F.regexp_count(c, F.lit("/")) / n).alias("slashes"),
        truth(before.rlike(r"[/\\.@~]$")).alias("path_before"),
        truth(before.rlike(rf"(?:{SECRET_WORDS})\S{{0,12}}\s{{0,3}}[:=]{{0,2}}\s{{0,3}}[\"']?$")).alias("secret_word"),
        truth(before.rlike(rf"(?:{OTHER_WORDS})\W{{0,6}}$")).alias("other_word"),
        truth(before.rlike(r"[:=]\s{0,3}[\"']?$")).alias("assigned"),
        truth(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")).alias("quoted"),
        truth(after.rlike(r"^[.,;]?\s+[A-Za-z]")).alias("sentence_after"),
    )


def labelled_findings(spark: SparkSession, n: int = 6000, start: int = 0) -> DataFrame:
    """``candidate, before, after, label``: n findings made by rule from number ``start`` on, half of them secrets.

    Candidates come from digests of the row number, cut to the shapes that keys, digests, numbers,
    identifiers and paths have; what stands around them is what mostly does in files and prose.
    """
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    mixed = F.translate(F.base64(F.unhex(digest("b"))), "+/=", "xYz")
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(values))) + 1).cast("int"))
    size = lambda salt, lo, hi: (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(hi - lo + 1)) + lo).cast("int")
    name = pick("name", ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "SECRET_KEY", "bearer", "signing_key"])
    prose = pick("prose", ["of the ", "was then ", "in and ", "le que ", "der und ", "los que ", "number ", ") ", "| ", "see ", "to "])
    mark = pick("mark", [' = "', '="', ": ", "=", " = '", ': "', " := \""])
    close = pick("close", ['"', "'", "", "\n", '"\n', '" the '])
    secret = F.concat(prose, name, mark)
    other = F.concat(prose, pick("other", ["commit ", "sha256:", "md5 ", "checksum: ", "revision ", "uuid ", "etag: ", "build ", "integrity ", "digest = ", "order ", "card "]))
    uuid = F.concat_ws("-", *[F.substring(digest("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    number = F.regexp_replace(digest("n"), "[a-f]", "7")
    word = pick("word", ["static/assets/images", "node-modules-package", "release-build-version", "user_data_files_index", "example_content_page", "thetestnameyourhere", "usr/local/lib/python", "sample-config-default"])
    letters = F.translate(mixed, "0123456789", "qWkZvJxPbH")
    syllables = ["tion", "ver", "un", "keit", "lich", "ment", "eux", "re", "th", "en", "da", "cion", "que", "ther", "ing", "heit", "scha", "ado", "la", "ble", "ou", "an"]
    natural = F.concat(*[pick(f"s{k}", syllables) for k in range(5)], pick("s5", ["", *syllables]), pick("s6", ["", "", *syllables]))
    names = ["get", "User", "Data", "From", "Index", "Page", "Service", "Manager", "Factory", "Handler", "Request", "Config", "Value", "Default", "Server", "Client"]
    camel = F.concat(*[pick(f"c{k}", names) for k in range(4)])
    hyphened = F.array_join(F.array(*[pick(f"h{k}", syllables) for k in range(4)], natural), "-")
    hyphened = F.replace(hyphened, F.lit("-"), pick("joint", ["-", "_", "/", "-"]))
    dummy = pick("dummy", ["your-api-key-here", "changeme-please", "example-password", "insert_token_here", "xxxxxxxxxxxx", "placeholder", "required", "optional", "disabled", "undefined", "replace-this-value", "test-password", "your_secret_token", "my-secret-value"])
    kinds = [
        (1, F.substring(digest("h"), F.lit(1), size("h", 32, 48)), secret, close),
        (1, F.substring(mixed, F.lit(1), size("m", 20, 43)), secret, close),
        (1, F.concat(pick("prefix", ["AKIA", "ghp_", "sk-", "xoxb-", "glpat-"]), F.substring(mixed, F.lit(1), size("p", 20, 36))), F.concat(prose, pick("how", ["", '"', "key ", "export KEY="])), close),
        (1, F.substring(F.upper(digest("g")), F.lit(1), size("g", 32, 64)), secret, close),
        (1, F.substring(mixed, F.lit(1), size("a", 24, 43)), F.concat(F.lit("Authorization: Bearer ")), close),
        (1, F.substring(letters, F.lit(1), size("l", 16, 43)), F.when(F.pmod(i, F.lit(4)) == 0, prose).otherwise(secret), close),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), F.concat(prose, pick("how", ["", '"', "key ", "id="])), close),
        (1, F.substring(mixed, F.lit(1), size("w", 8, 15)), secret, close),
        (1, F.lower(F.substring(letters, F.lit(1), size("v", 8, 24))), secret, close),
        (0, F.substring(digest("c"), F.lit(1), F.when(F.pmod(i, F.lit(2)) == 0, 40).otherwise(64)), other, pick("end", [" ", ".", ", the", "\n"])),
        (0, uuid, F.concat(prose, pick("id", ["id ", "uuid=", "guid: ", "", "request ", "id = \""])), close),
        (0, F.substring(number, F.lit(1), size("d", 16, 24)), prose, pick("after", [" and", ". The", "### ", " re", "\n"])),
        (0, F.concat(word, F.lit("-"), F.substring(number, 1, 2)), F.concat(prose, pick("root", ["/", "./", "https://www.example.com/", ""])), pick("ext", [".html", ".png", " ", "."])),
        (0, F.concat(F.repeat(pick("x", ["x", "0", "1", "abc1", "test", "1234"]), 8), F.lit("1")), secret, close),
        (0, F.when(F.pmod(i, F.lit(3)) == 0, F.initcap(natural)).when(F.pmod(i, F.lit(3)) == 1, F.upper(natural)).otherwise(natural), prose, pick("after", [" and", ". The", "### ", " re", "\n"])),
        (0, hyphened, F.concat(prose, pick("root", ["", "", "/", "#"])), pick("after", [" and", ". The", ", ", " re", "\n"])),
        (0, camel, F.concat(prose, pick("call", ["", "new ", "this.", "`", "import "])), pick("paren", ["(", " ", ".", "`"])),
        (0, dummy, secret, close),
    ]
    kinds = [(F.lit(label), *rest) for label, *rest in kinds]
    kind = F.pmod(i, F.lit(len(kinds)))
    choose = lambda k: reduce(lambda w, x: w.when(kind == x[0], x[1][k]), list(enumerate(kinds))[1:], F.when(kind == 0, kinds[0][k]))
    return spark.range(start, start + n).select(choose(1).alias("candidate"), choose(2).alias("before"), choose(3).alias("after"), choose(0).cast("double").alias("label"))


def _compiled(node) -> Column:
    """A tree's share of secrets at the leaf that a row falls into."""
    if node.subtreeDepth() == 0:
        counts = [float(x) for x in node.impurityStats().stats()]
        return F.lit(counts[1] / max(sum(counts), 1e-12))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= split.threshold(), _compiled(node.leftChild())).otherwise(_compiled(node.rightChild()))


def train_forest(spark: SparkSession, findings: DataFrame | None = None, trees: int = 12, depth: int = 6, seed: int = 7, max_findings: int = 100_000) -> Column:
    """The forest's probability that a candidate is a secret, as an expression over FEATURES.

    ``findings`` holds ``candidate, before, after, label``; of more than ``max_findings`` rows, as many are taken
    by hash. They are put in one partition in a fixed order, so that equal findings give an equal forest.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if findings is not None:
        findings = findings.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "label").limit(max_findings)
    rows = features(findings if findings is not None else labelled_findings(spark)).select("label", *FEATURES).coalesce(1)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)
    return reduce(lambda a, b: a + b, [_compiled(t._java_obj.rootNode()) for t in model.trees]) / F.lit(float(trees))


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, start, candidate, before, after`` for each match of CANDIDATE."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    # What stands between candidates gives their places and neighbours; lengths are summed by chunks first.
    rows = rows.select("doc_id", "found", F.split("text", CANDIDATE, -1).alias("gaps"))
    rows = rows.withColumn("sizes", F.transform("found", lambda x, k: (F.length(x) + F.length(F.get("gaps", k))).cast("long")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x)
    rows = rows.withColumn("sums", F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / CHUNK).cast("int")), lambda k: total(F.slice("sizes", k * CHUNK + 1, F.lit(CHUNK)))))

    def one(x: Column, k: Column) -> Column:
        chunk = F.floor(k / CHUNK).cast("int")
        gap, following = F.get("gaps", k), F.get("gaps", k + 1)
        start = total(F.slice("sums", F.lit(1), chunk)) + total(F.slice("sizes", chunk * CHUNK + 1, k - chunk * CHUNK)) + F.length(gap)
        before = F.substring(gap, F.greatest(F.length(gap) - BEFORE + 1, F.lit(1)), F.lit(BEFORE))
        return F.struct(start.alias("start"), x.alias("candidate"), before.alias("before"), F.substring(following, 1, AFTER).alias("after"))

    return rows.select("doc_id", F.posexplode_outer(F.transform("found", one)).alias("place", "z")).select("doc_id", "place", "z.start", "z.candidate", "z.before", "z.after")


def scan(spark: SparkSession, docs: DataFrame, forest: Column | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, start, length, sha256, score, is_secret, candidate`` for each candidate.

    Candidates are whole runs of 16 and more letters, digits and ``+/_-``, with or without digits, and shorter
    ones from 8 on where a secret is named and assigned before them; passwords of other characters, and shorter
    ones, are none. ``start`` is 0-based, in characters; ``sha256`` names the string without showing it. A null
    text has no candidates; ids may be null or repeat (each row is scanned); texts are read whole; columns not
    named are ignored; an empty table gives none.
    """
    score = forest if forest is not None else train_forest(spark)
    rows = features(find_candidates(docs, id_col, text_col)).withColumn("score", F.round(score, 6))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("sha256"), "score", (F.col("score") >= threshold).alias("is_secret"), "candidate")


def redact(spark: SparkSession, docs: DataFrame, forest: Column | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced by REDACTED wherever it stands in its row, and ``length_col`` set anew.

    Rows are keyed by id and text, so rows that repeat an id are each treated. Rows without secrets,
    null texts included, stay as they are; all columns stay.
    """
    keyed = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col)))
    found = scan(spark, keyed.drop(id_col).withColumnRenamed("__key", "__id"), forest, threshold, "__id", text_col).where("is_secret")
    secrets = found.groupBy(F.col("doc_id").alias("__key")).agg(F.array_sort(F.collect_set("candidate")).alias("__secrets"))
    out = keyed.join(secrets, "__key", "left")
    # Longer ones first, in case one is part of another.
    ordered = F.array_sort("__secrets", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    clean = F.when(F.col("__secrets").isNull(), F.col(text_col)).otherwise(F.aggregate(ordered, F.col(text_col), lambda t, s: F.replace(t, s, F.lit(REDACTED))))
    out = out.withColumn("__clean", clean)
    changed = {text_col: F.col("__clean")}
    if length_col and length_col in docs.columns:
        changed[length_col] = F.when(F.col("__secrets").isNull(), F.col(length_col)).otherwise(F.length("__clean").cast(docs.schema[length_col].dataType))
    return out.withColumns(changed).select(*docs.columns)
