"""Operator 6, secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions and MLlib only."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: A name that tells of a secret, with the sign and the quote after it; a value so assigned has 8 or more characters, of any kind up to the quote's end.
#: The pairs of letters that such names begin with are looked for first, as that is cheaper.
NAMED = r"(?=[AaCcEePpSsTt][AaCcEeIiNnOoPpRrUuWw])(?i:passw(?:or)?d|passphrase|pwd|secret|token|credential|(?:api|access|private|auth|signing|encryption)[_\-]?key)[A-Za-z0-9_\-]{0,24}[\"'\]]?[ \t]{0,3}(?::=|=>|[:=](?![:=]))[ \t]{0,3}[\"'`]?"
VALUE = r"(?:(?<=[\"'`])[^\s\"'`]{8,}|[^\s\"'`,;(){}\[\]<>]{8,})"
#: The user of an address, before its password.
USER = r"://[^\s/:@\"']{1,64}:"
#: A run of at least 16 characters that secrets are written in, with its padding, unless it is or ends in a telling name of a value.
RUN = rf"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z0-9+/_.\-]{{16}})(?![A-Za-z0-9+/_.\-]*?{NAMED}{VALUE})[A-Za-z0-9+/_.\-]{{16,}}+(?:={{1,2}}(?![A-Za-z0-9+/_.\-=]))?"
#: A hit: what leads to a candidate (a telling name or a user), if anything does, and the candidate.
CANDIDATE = rf"{RUN}|{NAMED}{VALUE}|{USER}[^\s/@\"']{{8,}}(?=@)"
LEAD = rf"^(?:{NAMED}(?={VALUE})|{USER})"
#: Words of the dictionary: the most frequent words of the corpus, in lower case, of these lengths.
DICTIONARY_WORDS, WORD_LENGTHS = 20_000, (3, 10)
#: Places that neighbouring words, and parts of the path, are hashed to; words looked at before and after a candidate.
HASHED, HASHED_PATH, BEFORE, AFTER = 2048, 64, 2, 1
LABELLED, SEED, TREES, DEPTH = 6000, 11, 40, 12
#: Labelled findings of a partition in training.
PART_ROWS = 3000
THRESHOLD = 0.5
FEATURES = ["f_length", "f_transitions", "f_runs", "f_digits", "f_upper", "f_hex", "f_vowels", "f_kinds", "f_dictionary", "f_assigned", "f_quoted"]
ROW = ["__id", "__key", "start"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(__id, __key, __path, start, candidate, before, after): every candidate with 40 characters on either side.

    start is its first code point. The text is split at the hits, so places follow from the lengths of what lies between; a name before a
    value is part of the hit, but goes to what is before the candidate.
    """
    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__key"), (F.col(path_col) if path_col else F.lit("")).cast("string").alias("__path"), F.col(text_col).alias("__text"))
    found = rows.where(text.rlike(CANDIDATE)).select("__id", "__key", "__path", F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("hit"), F.split(text, CANDIDATE, -1).alias("gap"))
    # each hit goes with what lies before and after it, and nothing else, so a document with very many hits costs no more than its hits
    n = F.size("hit")
    before = F.transform(F.slice("gap", F.lit(1), n), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(40)).alias("tail")))
    after = F.transform(F.slice("gap", F.lit(2), n), lambda g: F.left(g, F.lit(40)))
    zipped = found.select("__id", "__key", "__path", F.arrays_zip("hit", before.alias("before"), after.alias("after")).alias("__z"))
    # the outer form, as the plain one has the optimizer ask for the array's size below, where it would extract and split anew
    each = zipped.select("__id", "__key", "__path", F.posexplode_outer("__z").alias("__i", "z")).where("__i is not null")
    flat = each.select("__id", "__key", "__path", "__i", F.col("z.hit").alias("hit"), F.col("z.before.n").alias("__before_n"), F.col("z.before.tail").alias("before"), F.col("z.after").alias("after"))
    ordered = Window.partitionBy("__id", "__key").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = F.regexp_extract("hit", LEAD, 0)
    start = F.sum(F.col("__before_n") + F.length("hit")).over(ordered) - F.length("hit") + F.length(lead)
    placed = flat.dropDuplicates(["__id", "__key", "__i"]).withColumn("start", start.cast("long"))
    return placed.select("__id", "__key", "__path", "start", F.substr("hit", F.length(lead) + 1).alias("candidate"), F.right(F.concat("before", lead), F.lit(40)).alias("before"), "after")


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> DataFrame:
    """(w, n): the most frequent words over all documents; a top-k of fixed size, counted with a map-side part."""
    low, high = WORD_LENGTHS
    split = F.explode(F.filter(F.split(F.lower(F.col(text_col)), "[^a-z]+"), lambda w: F.length(w).between(low, high)))
    counts = docs.select(split.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return checkpointed(counts.orderBy(F.desc("n"), "w").limit(words))


def transitions(words: DataFrame) -> list[float]:
    """ln of the probability of each letter after each letter in the dictionary's words, by how often they occur; 26 letters and all else, 729 numbers."""
    at = F.explode(F.sequence(F.lit(1), F.length("w") - 1))
    pairs = words.select("w", "n", at.alias("i")).groupBy(F.substr("w", F.col("i"), F.lit(2)).alias("p")).agg(F.sum("n").alias("n")).collect()
    table = [[1.0] * 27 for _ in range(27)]
    for r in pairs:
        table[ord(r["p"][0]) - 97][ord(r["p"][1]) - 97] += r["n"]
    return [math.log(x / sum(row)) for row in table for x in row]


def _share(pattern: str, c: Column) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def features(found: DataFrame, words: DataFrame, ln: list[float]) -> DataFrame:
    """found (ROW, candidate, before, after, __path) with FEATURES, __beside, the words next to the candidate, and __folders, the parts of its path; all are built-in expressions.

    f_transitions is the mean ln of the probability of the candidate's letters, each after the one before it; f_dictionary the share of the candidate that is whole
    words of the dictionary, which is looked up by a join (it has at most DICTIONARY_WORDS rows, and is broadcast).
    """
    c = F.col("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "1"), "[^aB1]+", "-")
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    flag = lambda x: x.cast("double")
    codes = F.transform(F.split(F.lower(c), ""), lambda x: F.when(x.between("a", "z"), F.ascii(x) - 97).otherwise(26))
    table, n = F.array(*[F.lit(x) for x in ln]), F.size("__codes")
    steps = F.zip_with(F.slice("__codes", F.lit(1), n - 1), F.slice("__codes", F.lit(2), n - 1), lambda a, b: F.element_at(table, a * 27 + b + 1))
    parts = lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")
    named = lambda kind, x: F.transform(x, lambda w: F.concat(F.lit(kind), w))
    beside = F.concat(named("<", F.slice(F.reverse(parts(before)), 1, BEFORE)), named(">", F.slice(parts(after), 1, AFTER)))
    pieces = F.transform(F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+|[A-Z]+"), 0), F.lower)
    each = found.withColumn("__w", F.explode_outer(pieces)).join(F.broadcast(words.select(F.col("w").alias("__w"), F.lit(True).alias("__known"))), "__w", "left")
    rest = [x for x in found.columns if x not in ROW]
    rows = each.groupBy(*ROW).agg(F.coalesce(F.sum(F.when(F.col("__known"), F.length("__w"))), F.lit(0)).alias("__covered"), *[F.first(x).alias(x) for x in rest])
    return rows.withColumn("__codes", codes).withColumns({
        "f_length": F.length(c).cast("double"),
        "f_transitions": F.coalesce(F.aggregate(steps, F.lit(0.0), lambda a, b: a + b) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)),
        "f_runs": F.length(kinds) / F.length(c),
        "f_digits": _share("[^0-9]", c),
        "f_upper": _share("[^A-Z]", c),
        "f_hex": _share("[^0-9a-fA-F]", c),
        "f_vowels": _share("[^aeiouAEIOU]", c),
        "f_kinds": (flag(c.rlike("[a-z]")) + flag(c.rlike("[A-Z]")) + flag(c.rlike("[0-9]")) + flag(c.rlike("[^A-Za-z0-9]"))),
        "f_dictionary": F.col("__covered") / F.length(c),
        "f_assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "f_quoted": flag(before.rlike("[\"'`]$")) + flag(after.rlike("^[\"'`]")),
        "__beside": beside,
        "__folders": parts(F.coalesce("__path", F.lit(""))),
    }).drop("__codes", "__covered")


def labelled_findings(spark: SparkSession, rows: int = LABELLED, held_out: bool = False) -> DataFrame:
    """Findings with label 1 (secret) or 0, made by rule from hashes: the default labels where a user has none of their own.

    Secrets have the formats that providers document, and are generic hexadecimal keys, passwords and passwords in addresses; others are the identifiers,
    addresses, numbers and hashes of programs and their documentation, and the words and references that telling names are given. They are written
    into lines, and found there as in documents. Nothing is taken from documents. With held_out, other forms of both, which are not learned from.
    """
    h = lambda salt: F.sha2(F.concat(F.lit(f"{SEED}:{salt}:"), F.col("id").cast("string")), 256)
    pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    of = lambda salt, *xs: F.try_element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), pick(salt, len(xs)) + 1)
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    base64 = lambda salt, n: F.substring(F.base64(F.unhex(F.concat(h(salt), h(salt + "'"), h(salt + '"')))), 1, n)
    letters = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(salt), h(salt + "'"), h(salt + '"')))), "[+/=]", ""), 1, n)
    digits = lambda salt, n: F.lpad(F.conv(F.substring(h(salt), 1, 12), 16, 10), n, "1")
    parts = "account active address array async buffer cache channel client cluster column config connection context controller convert counter current default delete document element enable encode event exception factory field filter format function global group handler header identifier image index information input instance interface internal iterator language library listener local manager maximum message method minimum module network number object operation option output package parameter parser pattern performance permission position previous process product property provider query reader record reference register remote request resource response result schedule schema section select sequence server service session setting source statement status storage stream string structure system table target template thread timeout transaction transform update value variable version widget window worker".split()
    words = lambda salt, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(F.array(*map(F.lit, parts)), F.pmod(F.xxhash64(F.lit(salt), F.col("id"), i), F.lit(len(parts))).cast("int") + 1))
    join = lambda salt, n, by: F.array_join(words(salt, n), by)
    camel = lambda salt, n: F.array_join(F.transform(words(salt, n), F.initcap), "")
    symbol = of("symbol", "!", "@", "#", "$", "%", "&", "*", "?", "-", "^", ".")
    if held_out:
        secret = of("kind", F.substring(h("a"), 1, 40), text("sk_live_", letters("a", 24)), text("glpat-", letters("a", 20)), text("npm_", letters("a", 36)), text(base64("a", 86), "=="))
        plain = of("plain", text("org.", join("p", 2, "."), "-", pick("m", 9).cast("string"), ".1.0"), text(join("p", 2, "_"), "__", join("q", 2, "-")), text("2024-0", (pick("m", 9) + 1).cast("string"), "-11T10.11.12"), text("lib", join("p", 3, "-"), ".so.", pick("m", 9).cast("string")), text(join("p", 3, "/"), ".md"))
        hashed, place = F.substring(h("c"), 1, 32), of("place", "md5: ", "MD5 = ", "checksum: ")
        password = of("pass", text(F.upper(letters("a", 3)), "-", F.lower(letters("b", 4)), "&", digits("a", 3), "!"), text(digits("a", 2), "_", letters("b", 7), "?"), text(F.translate(join("p", 2, ""), "aeos", "@30$"), pick("n", 99).cast("string")))
        weak = of("weak", text(camel("p", 2), "Field"), text("vault.lookup.", join("p", 1, "")), text("to-be-", join("p", 2, "-")), text("this.", camel("p", 2)))
    else:
        secret = of("kind", F.substring(h("a"), 1, 32), h("a"), F.substring(h("a"), 1, 48), text("AKIA", F.upper(letters("a", 16))), base64("a", 40), text("ghp_", letters("a", 36)), text("xoxb-", digits("a", 12), "-", digits("b", 12), "-", letters("a", 24)), text("AIza", letters("a", 35)), text("eyJ", letters("a", 17), ".", letters("b", 40), ".", letters("c", 43)), text("SG.", letters("a", 22), ".", letters("b", 43)), letters("a", 20))
        uuid = text(F.substring(h("u"), 1, 8), "-", F.substring(h("u"), 9, 4), "-4", F.substring(h("u"), 13, 3), "-a", F.substring(h("u"), 16, 3), "-", F.substring(h("u"), 19, 12))
        plain = of(
            "plain", camel("p", 3), join("p", 3, ""), join("p", 3, "_"), join("p", 3, "."), join("p", 3, "-"), F.upper(join("p", 3, "_")), F.upper(join("p", 3, "")), text(join("p", 3, ""), "."), text(F.upper(join("p", 2, "")), "..."),
            text("/", join("p", 3, "/")), text("//www.", join("p", 2, "-"), ".com/", join("q", 2, "/"), ".html"), text(join("p", 2, "."), ".example.org"), uuid, digits("n", 16), text(digits("n", 12), ".", digits("o", 6)), text(camel("p", 2), "-", pick("m", 9).cast("string"), ".0.1.tar.gz"), "-" * 24,
        )
        password = of("pass", text(camel("p", 1), symbol, pick("n", 9999).cast("string"), "!"), text(letters("a", 5), symbol, letters("b", 5), "+"), F.translate(base64("a", 12), "abcdef+/", "!@#$%^&*"), text(F.translate(camel("p", 2), "aeio", "4310"), symbol), letters("a", 12), text(letters("a", 9), pick("n", 99).cast("string")), F.substring(h("a"), 1, 12))
        weak = of("weak", join("p", 2, ""), join("p", 2, "_"), camel("p", 2), text("your-", join("p", 1, ""), "-here"), text("<your_", join("p", 1, ""), ">"), text("get", camel("p", 1), "()"), text("process.env.", F.upper(join("p", 1, ""))), text("config.", join("p", 2, ".")), digits("n", 12), text("/", join("p", 2, "/")), text(join("p", 1, ""), "@example.org"), "********", text("${", F.upper(join("p", 2, "_")), "}"), join("p", 1, ""), text("a", join("p", 2, "-"), "."))
        hashed, place = of("hash", F.substring(h("c"), 1, 40), h("c"), F.substring(h("c"), 1, 32)), of("place", "commit ", "sha1: ", "sha256:", "md5: ", "checksum=", "digest ", 'src="', "https://", "uuid: ")
    name = of("name", "token", "secret", "password", "api_key", "API-KEY", "access_key", "auth_token", "private_key", "credential")
    lead = F.concat(join("l", 4, " "), F.lit(" "))
    telling = F.concat(lead, of("gap", name, F.upper(name)), of("sign", " = ", "=", ": ", ":"), of("quote", '"', "'", ""))
    label, other = pick("label", 2) == 1, pick("other", 4)
    short, user = label & (pick("short", 3) == 0), pick("user", 5) == 0
    address = F.concat(lead, of("scheme", "postgres://", "https://", "redis://", "amqp://", "mysql://"), join("u", 1, ""), F.lit(":"))
    before = F.when(short & user, address).when(short, telling).when(label, F.when(pick("bare", 8) > 0, telling).otherwise(F.concat(lead, F.lit('"'))))
    before = before.when(other == 0, F.concat(lead, place)).when(other == 1, telling).otherwise(F.concat(lead, of("odd", "", "", "", '"', "= ", "(", "@", name)))
    end = F.when(short & user, F.concat(F.lit("@"), join("e", 2, "."))).when(label, of("end", '"', '"', "'", "", "\n", '",'))
    lines = spark.range(rows).select(
        "id",
        label.cast("double").alias("label"),
        F.when(short, password).when(label, secret).when(other == 0, hashed).when(other == 1, weak).otherwise(plain).alias("planted"),
        before.alias("lead"),
        end.otherwise(of("end0", " ", ")", ", ", '"', "", "\n")).alias("end"),
        F.when(pick("path", 10) == 0, F.lit("tests/data")).otherwise(F.lit("src1")).alias("path"),
    )
    lines = lines.withColumn("line", F.concat("lead", "planted", "end"))
    found = candidates(lines, "id", "line", "path").join(lines.select(F.col("id").alias("__id"), "label", "planted"), "__id")
    return found.select(F.when(F.contains("planted", "candidate"), F.col("label")).otherwise(0.0).alias("label"), "candidate", "before", "after", "__path")


def _rows(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"__id": F.monotonically_increasing_id(), "__key": F.lit(0), "start": F.lit(0)})


class Forest:
    """A random forest over FEATURES and the hashed words beside a candidate, with what its features need."""

    def __init__(self, findings: DataFrame, words: DataFrame) -> None:
        """Trained on labelled findings: columns label, candidate, before, after, __path."""
        self.words, self.ln = words, transitions(words)
        stages = [
            HashingTF(inputCol="__beside", outputCol="__hashed", numFeatures=HASHED, binary=True),
            HashingTF(inputCol="__folders", outputCol="__hashed_path", numFeatures=HASHED_PATH, binary=True),
            VectorAssembler(inputCols=[*FEATURES, "__hashed", "__hashed_path"], outputCol="__features"),
            RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=SEED, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y"),
        ]
        # every partition sends statistics of every node of the trees, so there are only as many as the findings' rows ask for
        parts = max(1, math.ceil(findings.count() / PART_ROWS))
        known = checkpointed(features(_rows(findings), words, self.ln).select("label", "__beside", "__folders", *FEATURES).coalesce(parts))
        self.model = Pipeline(stages=stages).fit(known)

    def rate(self, found: DataFrame) -> DataFrame:
        """found with probability."""
        return self.model.transform(features(found, self.words, self.ln)).withColumn("probability", F.round(vector_to_array("__p")[1], 6))

    def precision_and_recall(self, findings: DataFrame) -> tuple[float, float]:
        y, p = F.col("label") == 1, F.col("probability") >= THRESHOLD
        r = self.rate(_rows(findings)).agg(F.count_if(y & p).alias("hit"), F.count_if(p).alias("said"), F.count_if(y).alias("there")).first()
        return r["hit"] / max(1, r["said"]), r["hit"] / max(1, r["there"])


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """All candidates of docs: __id, start, length, candidate, before, after, probability, is_secret.

    findings are labelled ones to learn from; without them those of labelled_findings. Null and empty texts have no candidates; texts of any length are
    scanned whole; ids and paths may be null; rows that repeat an id and a text are scanned once; ties at the threshold count as secret; other columns are not read. An
    empty table gives an empty table.
    """
    forest = Forest(labelled_findings(docs.sparkSession) if findings is None else findings, dictionary(docs, text_col))
    rated = forest.rate(candidates(docs, id_col, text_col, path_col))
    return rated.select("__id", "start", F.length("candidate").alias("length"), "candidate", "before", "after", "probability", (F.col("probability") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every secret in found replaced by a mark."""
    hits = found.where("is_secret").groupBy(F.col("__id").alias("__sid")).agg(F.collect_set("candidate").alias("__secrets"))
    text = F.aggregate(F.coalesce("__secrets", F.array().cast("array<string>")), F.col(text_col), lambda t, s: F.replace(t, s, F.lit(mark)))
    return docs.join(hits, F.col(id_col).eqNullSafe(F.col("__sid")), "left").withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
