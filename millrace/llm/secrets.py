"""Secret scans: candidates by pattern, false positives removed by a random forest.

Features of a candidate are its length, transitions between characters, coverage
by dictionary words, path shape, and words around it. The forest is trained on
labelled findings, which come from texts by the same pattern as those to be
judged. All of it is DataFrame expressions and the DataFrame API of the machine
learning library.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut

#: Words near a candidate that speak for a secret, and against.
FOR_WORDS = "key|token|secret|passw|passwd|pwd|auth|bearer|credential|private|signature|session|cookie|api"
AGAINST_WORDS = "example|sample|dummy|placeholder|test|commit|sha1|sha256|md5|checksum|digest|revision|uuid|guid|isbn|card|phone|mail|version|build|order|invoice"

_CHARS = r"A-Za-z0-9+/_.@\-"
_OPEN = r"""[^\s"'<>,;(){}\[\]]"""
#: What assigns a value to a name that speaks for a secret: the rest of the name, a sign, a quotation mark.
ASSIGNED = rf"""(?i:(?:{FOR_WORDS})[A-Za-z_ \-]{{0,12}}+["']?[ \t]{{0,3}}+[=:][ \t]{{0,3}}+(?:Bearer )?["']?)"""
#: A value of 8 characters or more that is assigned so, with its name; elsewhere a maximal run of 12 or more characters
#: with a digit, and signs of equality only as padding at its end.
CANDIDATE = rf"{ASSIGNED}{_OPEN}{{8,}}(?<![.!?:])|(?<![{_CHARS}])(?=[A-Za-z+/_.@\-]*+[0-9])[{_CHARS}]{{12,}}+(?:={{1,2}}(?![{_CHARS}=]))?"
#: Characters before and behind a candidate that are looked at.
BEFORE, AFTER = 48, 16
REDACTED = "[secret]"
#: Candidates of a text whose lengths are added up one by one; blocks of them are added up before.
_BLOCK = 64

#: Words that identifiers and paths are made of.
DICTIONARY = """
about account action admin after agent alpha amazon android apache array async backup base beta binary block board body branch
browser buffer build button cache call card change channel check child class clean click client cloud code column commit common
company config connect console contact content context control copy core count create current custom daily data date debug default
delete demo deploy detail device digest dir direct disk display docker document domain download draft driver dummy edit email empty
enable encode engine entry error event example export factory failed false feature field file filter final first folder font form
format frame free from full function game general global google graph green group guide handler hash head header hello help home
host html http https image import index info input install internal item java job json keyboard label language large last layout lib
license light limit line link linux list load local location login long main manager market master match media memory menu message
method mobile mode model module monitor month name native net network news next node none note number object office offline online
open option order origin output package page panel parent part partner patch path payment phone photo picture place plain play plugin
point policy popular port post price print process product profile program project public query queue random read record region
release remote report request resource response result right root route sample scale schema screen script search section select
send server service session setting share short side simple single site size small software source spark square stack stage start
state static status step stock storage store stream string style support switch system table target task team temp template test
text theme thread time title tool topic track train trans true type under unit unix update upload user util value vendor version
video view visit volume warning web week weight window word work world year zone
""".split()

#: Pairs of letters that are frequent in words, and rare in keys.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

FEATURES = ["length", "transitions", "pairs", "letters", "distinct", "digits", "uppers", "symbols", "hex", "dictionary", "slashes", "dots", "at", "extension", "assigned", "quoted", "for_words", "against_words", "against_inside"]


def features(token: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers that the forest judges a candidate by."""
    n = F.length(token)
    letters = string.ascii_lowercase + string.ascii_uppercase + string.digits
    kinds = F.translate(token, letters, "a" * 26 + "A" * 26 + "0" * 10)
    without = lambda pattern: n - F.length(F.regexp_replace(token, pattern, ""))
    long_first = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    low = F.lower(token)
    near = F.lower(before)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": n.cast("double"),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1*+", "x")) - 1) / n,
        "pairs": F.regexp_count(low, F.lit(f"(?=(?:{'|'.join(PAIRS)}))")) / n,
        "letters": without("[A-Za-z]") / n,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "digits": without("[0-9]") / n,
        "uppers": without("[A-Z]") / n,
        "symbols": without("[^A-Za-z0-9]") / n,
        "hex": flag(low.rlike("^[0-9a-f]+$")),
        "dictionary": (n - F.length(F.regexp_replace(low, f"(?:{long_first})", ""))) / n,
        "slashes": without("/").cast("double"),
        "dots": without("[.]").cast("double"),
        "at": without("@").cast("double"),
        "extension": flag(low.rlike(r"\.[a-z]{2,4}$")),
        "assigned": flag(before.rlike(r"""[=:>(]\s*["']?$""")),
        "quoted": flag(before.rlike(r"""["']$""") & after.rlike(r"""^["']""")),
        "for_words": flag(near.rlike(f"(?:{FOR_WORDS})[a-z_ -]*+[\\s=:>\"'(]*+$")),
        "against_words": flag(near.rlike(f"(?:{AGAINST_WORDS})")),
        "against_inside": flag(low.rlike("example|sample|dummy|placeholder|test|changeme|your")),
    }


def _found(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns of rows with candidates, ``_found`` (each with the name it is assigned to) and ``_between``, the texts around them."""
    both = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split(text, CANDIDATE).alias("_between"))
    return docs.select(*keep, F.inline(F.array(both))).where(F.size("_found") > 0)


def _name(found: Column) -> Column:
    return F.regexp_extract(found, f"^{ASSIGNED}", 0)


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``no`` (from 0 in each row), ``start`` (code points from 0), ``token``, ``before`` and ``after`` of every candidate of every text."""
    lengths = F.zip_with("_found", F.slice("_between", F.lit(1), F.size("_found")), lambda f, b: (F.length(f) + F.length(b)).cast("long"))
    zero = F.lit(0).cast("long")
    add = lambda x: F.aggregate(x, zero, lambda n, k: n + k)
    rows = _found(docs, keep, text).select(*keep, "_found", "_between", F.explode(F.array(lengths)).alias("_lengths"))
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lengths") - 1) / _BLOCK).cast("int")), lambda k: add(F.slice("_lengths", k * _BLOCK + 1, F.lit(_BLOCK))))
    rows = rows.select(*keep, "_found", "_between", "_lengths", F.explode(F.array(block)).alias("_block"))
    upto = F.aggregate("_block", F.array(zero), lambda ends, n: F.array_append(ends, F.element_at(ends, -1) + n))
    rows = rows.select(*keep, "_found", "_between", "_lengths", F.explode(F.array(upto)).alias("_upto"))

    def one(found: Column, i: Column) -> Column:
        at = F.floor(i / _BLOCK).cast("int")
        gap, name = F.get("_between", i), _name(found)
        start = F.get("_upto", at) + add(F.slice("_lengths", at * _BLOCK + 1, i % _BLOCK)) + F.length(gap) + F.length(name)
        token = F.substring(found, F.length(name) + 1, F.length(found))
        return F.struct(i.alias("no"), start.alias("start"), token.alias("token"), F.right(F.concat(gap, name), F.lit(BEFORE)).alias("before"), F.left(F.get("_between", i + 1), F.lit(AFTER)).alias("after"))

    return rows.select(*keep, F.inline(F.transform("_found", one)))


def labelled_findings(spark: SparkSession, n: int = 8000, seed: int = 11) -> DataFrame:
    """Findings ``before``, ``token``, ``after``, ``label`` (1: a secret) from ``n`` made-up texts, the same on every call.

    Half of the texts hold a secret: hex, base64 and prefixed keys, random letters and passwords that stand where such
    things are assigned. In the others are look-alikes: digests, numbers, ids, mail addresses, paths, links, versions,
    names and placeholders, also words where secrets could be assigned. The findings are what ``candidates`` finds.

    What is used more than once is a column of its own, and a choice of words one literal: written out wherever they
    are used, they make a plan of many thousand nodes, all of it in the driver's memory.
    """
    made = spark.range(n, numPartitions=2)

    def held(**columns: Column) -> list[Column]:
        nonlocal made
        made = made.withColumns(columns)
        return [F.col(c) for c in columns]

    def pick(tag: str, *of: str | Column) -> Column:
        if all(isinstance(x, str) for x in of):
            choice = F.split(F.lit("\x1f".join(of)), "\x1f")
        else:
            choice = F.array(*(F.lit(x) if isinstance(x, str) else x for x in of))
        return F.element_at(choice, number(tag, len(of)) + 1)

    h = lambda tag: F.sha2(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), F.lit(tag)).cast("binary"), 256)
    number = lambda tag, most: F.pmod(F.xxhash64("id", F.lit(f"{seed}{tag}")), F.lit(most)).cast("int")
    hex_, ids, base, digits = held(_hex=h("h"), _ids=h("u"), _base=F.translate(F.base64(F.unhex(h("b"))), "=\n", ""), _digits=F.translate(h("d"), "abcdef", "123456"))
    held(**{f"_word_{tag}": pick(tag, *DICTIONARY[::3]) for tag in ("w1", "a", "b", "c", "d", "e", "f")})
    word = lambda tag: F.col(f"_word_{tag}")
    (letters,) = held(_letters=F.translate(base, "0123456789+/", "qZvXkJwYgHpB"))
    some = F.substring(base, F.lit(1), number("n", 24) + 16)
    assigned = pick("p", 'token = "', 'token="', "token: ", "token=", 'api_key = "', 'api_key="', 'secret="', "secret=", "password=", 'password="', "password: ", "passwd=", "Authorization: Bearer ", "export SECRET_KEY=", '"private_key": "', 'auth_token: "', "api key: ", "credential = '", "AUTH_TOKEN=", "access-key: ")
    letter_key = F.substring(pick("l", letters, F.lower(letters), F.upper(letters)), F.lit(1), number("m", 24) + 12)
    short = F.concat(F.substring(base, F.lit(1), number("k", 5) + 6), pick("y", "!", "#", "$", "%", "7", "x9"), F.substring(digits, 1, 1))
    letter_key, short = held(_letter_key=letter_key, _short=short)
    secret = pick("s", F.substring(hex_, 1, 40), F.substring(hex_, 1, 40), F.substring(hex_, 1, 32), hex_, F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(base, "+/", "XY"), 1, 16))), F.concat(F.lit("ghp_"), F.substring(F.translate(base, "+/", "xy"), 1, 36)), F.concat(F.lit("sk-"), F.translate(base, "+/", "xy")), base, some, F.concat(word("w1"), F.lit("_"), F.substring(base, 1, 10), F.substring(digits, 1, 2)), letter_key, letter_key, short, short)
    hex_part = lambda a, k: F.substring(ids, a, k)
    other = pick(
        "o",
        F.concat_ws("-", hex_part(1, 8), hex_part(9, 4), hex_part(13, 4), hex_part(17, 4), hex_part(21, 12)),
        F.substring(digits, 1, 16), F.substring(digits, 1, 12),
        F.concat(word("c"), F.lit("."), F.substring(digits, 1, 2), F.lit("@mail"), F.substring(digits, 3, 1), F.lit(".example.com")),
        F.concat(F.lit("/usr/"), word("c"), F.lit("/"), word("d"), F.substring(digits, 1, 2), F.lit("/"), word("e"), F.lit(".py")),
        F.concat(word("c"), F.lit("/"), word("d"), F.lit("-"), F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 1), F.lit("."), F.substring(digits, 3, 2), F.lit(".tar.gz")),
        F.concat(F.lit("//www."), word("c"), F.lit(".com/"), word("d"), F.lit("/"), F.substring(digits, 1, 4)),
        F.concat(word("c"), F.initcap(word("d")), F.initcap(word("e")), F.substring(digits, 1, 2)),
        F.concat(word("c"), F.lit("_"), word("d"), F.lit("_"), F.substring(digits, 1, 3)),
        F.concat_ws(".", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 3), F.substring(digits, 10, 3)),
        F.concat(F.lit("2024-"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("T"), F.substring(digits, 5, 2)),
        F.substring(hex_, 1, 40), hex_,
        F.concat(F.lit("your_example_key_"), F.substring(digits, 1, 4)), F.concat(F.lit("EXAMPLE"), F.substring(F.upper(hex_), 1, 12)),
    )
    worded = pick(
        "v",
        F.concat(word("c"), word("d")), F.concat(word("c"), F.lit("_"), word("d")), F.concat(word("c"), F.initcap(word("d"))), F.concat(word("c"), F.lit("-"), word("d")),
        F.concat(word("c"), F.lit("ing"), word("e")), F.upper(F.concat(word("c"), F.lit("_"), word("d"))), F.concat(word("c"), F.lit("."), word("d"), F.lit("."), word("e")),
        F.concat(F.lit("/usr/"), word("c"), F.lit("/"), word("d")), F.concat(F.lit("your_"), word("c"), F.lit("_here")), F.concat(F.lit("https://"), word("c"), F.lit(".com/"), word("d")),
        F.concat(F.lit("$"), F.upper(word("c")), F.lit("_"), F.upper(word("d"))), F.lit("changeme1234"), F.lit("required."), F.lit("undefined"), F.lit("xxxxxxxxxxxx"), F.lit("************"),
    )
    (other,) = held(_other=other)
    digest = other.rlike("^[0-9a-f]{40,}$")
    plain = F.when(digest, pick("q", " commit ", " sha256: ", " checksum ", " digest = ", " revision ", " md5:")).otherwise(pick("r", " ", " ", " (", ", ", ": ", " = ", " see ", " token "))
    secretive, in_place = F.col("id") % 2 == 0, F.col("id") % 4 == 1
    token = F.when(secretive, secret).when(in_place, worded).otherwise(other)
    token, before = held(_token=token, _before=F.concat(word("a"), F.lit(" "), word("b"), F.when(secretive | in_place, F.concat(F.lit(" "), assigned)).otherwise(plain)))
    (last,) = held(_last=F.substring(before, -1, 1))
    after = F.when(last.isin('"', "'"), last).otherwise(pick("t", " ", "\n", ". ", ", ", ") "))
    made = made.select(secretive.cast("double").alias("label"), token.alias("made"), F.concat(before, token, after, F.lit(" "), word("f")).alias("text"))
    return candidates(made, ["label", "made"]).where((F.col("label") == 0) | (F.col("token") == F.col("made"))).select("before", "token", "after", "label")


def _vectors(found: DataFrame) -> DataFrame:
    own = features(F.col("token"), F.col("before"), F.col("after"))
    return VectorAssembler(inputCols=[f"_f_{n}" for n in FEATURES], outputCol="_features").transform(found.withColumns({f"_f_{n}": own[n] for n in FEATURES})).drop(*(f"_f_{n}" for n in FEATURES))


def train(findings: DataFrame, trees: int = 20, depth: int = 8, seed: int = 3, limit: int = 200_000) -> RandomForestClassificationModel:
    """A forest from labelled findings ``before``, ``token``, ``after``, ``label`` (1: a secret), of which at most ``limit`` count.

    Findings with a null in any of these are left out. There must be some of either label.
    """
    rows = findings.select("before", "token", "after", F.col("label").cast("double").alias("label")).na.drop().limit(limit)
    rows = cut(rows.sortWithinPartitions(*rows.columns))  # every step of the fit reads them; one order gives one forest
    model = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(_vectors(rows))
    rows.sparkSession.sparkContext._jvm.System.gc()  # what was gathered for the fit goes before the scan begins
    return model


def judge(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Adds ``probability`` of being a secret to candidates."""
    judged = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_probability").transform(_vectors(found))
    return judged.withColumn("probability", vector_to_array("_probability")[1]).drop("_features", "_probability")


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``id``, ``start`` (code points from 0), ``token`` and ``probability`` of every candidate that the forest holds for a secret.

    A null or empty text has none. Repeated rows and null ids have theirs, row by row; other columns are not read.
    """
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    found = judge(candidates(rows, ["_id"], "_text"), model).where(F.col("probability") >= least)
    return found.select(F.col("_id").alias(id), "start", "token", "probability")


def redact(docs: DataFrame, model: RandomForestClassificationModel, id: str = "doc_id", text: str = "text", least: float = 0.5, changed: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ``[secret]`` for each secret in ``text``, and whether there was any in ``changed`` if named.

    All rows stay, null and empty texts as they are. A secret goes where it was found; the same characters within
    another candidate stay. Only texts with candidates are shuffled, by id and content.
    """
    some = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    key = {"_k1": F.xxhash64(F.col(id).cast("string"), text), "_k2": F.xxhash64(text, F.lit(7))}
    rows = docs.where(some).withColumns(key)
    found = judge(candidates(rows, ["_k1", "_k2"], text), model).select("_k1", "_k2", F.struct("no", (F.col("probability") >= least).alias("hit")).alias("hit"))
    hits = found.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("hit"))["hit"].alias("_hits")).where(F.array_contains("_hits", True))
    clean = lambda f, hit: F.when(hit, F.concat(_name(f), F.lit(REDACTED))).otherwise(f)
    cleaned = F.zip_with(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), "_hits", clean)
    whole = F.array_join(F.zip_with(F.split(text, CANDIDATE), cleaned, lambda b, f: F.concat(b, F.coalesce(f, F.lit("")))), "")
    joined = rows.join(hits, ["_k1", "_k2"], "left").withColumn(text, F.when(F.col("_hits").isNull(), F.col(text)).otherwise(whole))
    flags = lambda df, flag: df if changed is None else df.withColumn(changed, flag)
    names = [*docs.columns, *([changed] if changed else [])]
    return flags(docs.where(~some), F.lit(False)).unionByName(flags(joined, F.col("_hits").isNotNull()).select(*names))
