"""Secret scans: pattern candidates, and a random forest that drops false positives.

DataFrame and SQL functions only. One pattern finds candidates: known key
formats, values assigned to a telling name, and long mixed tokens. The text
between candidates, from the same pattern, gives positions, neighbouring words
and the redacted text, so no row leaves its partition. A forest trained on
labelled findings (Spark's own trainer, in the JVM) is turned into a SQL
expression of its trees' votes over features: length, shares of character
kinds, transitions between kinds, coverage by dictionary words and syllables,
the document's path or source, and the words before.

Labelled findings come as a table (before, candidate, path, label). Where a
corpus has none, ``generated_findings`` makes a documented set: keys and
passwords of several kinds against placeholders, checksums, identifiers and
prose.

Defined results: null and empty texts have no candidates (a null text stays
null); a missing path or source counts as empty; repeated rows are scanned
alike; an empty table gives no rows; other columns are kept. A document
without secrets keeps its text as it is.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH, SEED = 20, 5, 11
#: Generated labelled findings, and the share of votes that makes a secret.
FINDINGS, SHARE = 6000, 0.5
REPLACEMENT = "<secret>"
NEAR = 48

#: Names that secrets are assigned to, and public key formats.
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credential"
FORMATS = (
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}+",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}+",
    r"\bAIza[A-Za-z0-9_-]{35}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}+",
    r"\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*+",
    r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----(?:\s*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+)*+[A-Za-z0-9+/=\s\\]*+-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----",
)
#: A telling name within a longer one (DB_PASSWORD, userPassword), up to the sign and quote before its value.
NAMED = rf"""(?i:(?:(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{{0,40}}?)?(?=[acpst])(?:{NAMES})[A-Za-z0-9_.-]{{0,40}})["']?\s{{0,3}}[:=]\s{{0,3}}["']?"""
ASSIGNED = rf"""{NAMED}(?!-----BEGIN )[^\s"']{{6,}}+["']?"""
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
PATTERN = "|".join((*FORMATS, ASSIGNED, MIXED))
WORDS = (
    "password passwd secret token example sample changeme change test dummy placeholder insert your here value default admin user name login "
    "access private public client server system data file image figure overview report index version number string null none true false todo "
    "goes some this that with from time date page home path local config service account account database production development"
).split()
CHECKSUMS = "commit|sha1|sha256|sha|md5|checksum|digest|hash|uuid|guid|revision|etag|id|figure"

FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "transitions", "distinct", "words", "syllables", "runs", "named", "known", "checksum", "template", "sample_path")


def value_of(candidate: Column) -> Column:
    """A candidate without the name it is assigned to and quotes."""
    bare = F.regexp_replace(candidate, f"^{NAMED}", "")
    return F.regexp_replace(bare, r"""["']$""", "")


def features(candidate: Column, before: Column, path: Column) -> dict[str, Column]:
    """The forest's inputs, each a number."""
    value = value_of(candidate)
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    covered = lambda pattern: (size - F.length(F.regexp_replace(F.lower(value), pattern, ""))) / size
    flag = lambda text, pattern: F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)).cast("double")
    kinds = r"(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[0-9])(?=[A-Za-z])"
    return {
        "length": size,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "transitions": share(kinds),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "words": covered("|".join(sorted(set(WORDS), key=lambda w: (-len(w), w)))),
        # possessive, so that it runs as a loop: without the last + each syllable is a call on the stack
        "syllables": covered("(?:[bcdfghjklmnpqrstvwxz]{0,2}[aeiouy]{1,2}[bcdfghjklmnpqrstvwxz]{0,1}){2,}+"),
        "runs": flag(value, r"(.)\1{4,}"),
        "named": flag(candidate, f"^{NAMED}"),
        "known": flag(candidate, "^(?:" + "|".join(FORMATS) + ")"),
        "checksum": flag(before, rf"(?i)\b(?:{CHECKSUMS})\b\W*$"),
        "template": flag(value, r"^(?:\$\{|\{\{|<|%\(|\$\()"),
        "sample_path": flag(path, r"(?i)\b(?:tests?|docs?|examples?|fixtures?|samples?)\b"),
    }


def generated_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """before, candidate, path, label: findings of twelve kinds, the first six of which are secrets.

    A bounded table; a row's digests decide everything in it.
    """
    names = ("password", "passwd", "pwd", "secret", "api_key", "access_key", "token")
    dummies = ("changeme", "your_password_here", "example123", "password1", "xxxxxxxxxxxxxxxx", "<insert-token>", "${TOKEN_VALUE}", "{{secret}}", "********", "00000000000", "placeholder", "test1234")
    found = []
    for n in range(rows):
        digest = hashlib.sha256(f"finding {n}".encode()).hexdigest()
        bits = int(hashlib.sha256(digest.encode()).hexdigest(), 16)

        def pick(options):
            nonlocal bits
            bits, k = divmod(bits, len(options))
            return options[k]

        mixed = base64.b64encode(bytes.fromhex(digest)).decode().translate(str.maketrans("+/=", "qqq"))
        upper = "".join("QNAZRGKTX234567BCDEFHIJLMOPSUVWY"[int(digest[k : k + 2], 16) % 32] for k in range(0, 32, 2))
        name, sign, size, prose = pick(names), pick(("=", ": ", " = ")), pick(range(12, 41)), f"{pick(WORDS)} {pick(WORDS)} "
        given = (pick(("DB_", "app.", "user_", "x-")) + name.upper() if n % 5 == 0 else name + pick(("_prod", "s", "-2", "Value")) if n % 5 == 1 else name) + sign
        uuid = "-".join((digest[:8], digest[8:12], digest[12:16], digest[16:20], digest[20:32]))
        candidate = (
            given + digest[:size],
            f'token = "{digest[:40]}"',
            "AKIA" + upper,
            given + mixed[:size],
            "ghp_" + mixed[:36],
            given + mixed[:7] + pick("!#%@$") + digest[:6],
            given + pick(dummies),
            given + pick(WORDS) + pick(("", "s", "ing", "word", "ation")) + pick(WORDS),
            digest[:40],
            uuid,
            pick("-_").join((pick(WORDS), pick(WORDS), pick(WORDS), pick(("2019", "12", "v2", "007")), pick(WORDS))),
            f"item{int(digest[:14], 16)}{pick(('0001', '2020', '1111'))}",
        )[n % 12]
        if n % 36 == 4:  # a third of the fifth kind are PEM blocks
            body, label = "".join(mixed[k:] + mixed[:k] for k in range(0, 44, 2)), pick(("RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", ""))
            header = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + digest[:32].upper() + "\n\n" if label == "RSA " and size % 2 else ""
            lines = [body[k : k + 64] for k in range(0, 64 * pick((1, 3, 12)), 64)]
            candidate = f"-----BEGIN {label}PRIVATE KEY-----\n{header}" + "\n".join(lines) + f"\n-----END {label}PRIVATE KEY-----"
        before = {8: pick(("commit", "sha1", "checksum:", "digest", "hash:", "revision")) + " ", 9: pick(("uuid", "id", "request", "see")) + " "}.get(n % 12, prose)
        sample = pick(range(10)) < (1 if n % 12 < 6 else 3)
        path = pick(("tests/fixtures/a.txt", "docs/example.md")) if sample else pick(("src1", "app/settings.py", "deploy/env", ""))
        found.append((before, candidate, path, float(n % 12 < 6)))
    return spark.createDataFrame(found, "before string, candidate string, path string, label double")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list:
    """The forest as nested tuples (feature, threshold, left, right) with votes 0 or 1 as leaves."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    columns = features(F.col("candidate"), F.col("before"), F.col("path"))
    rows = findings.select("label", *[c.cast("double").alias(name) for name, c in columns.items()])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="skip").transform(rows.where("label is not null"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(rows.select("label", "features"))
    return [_tree(iter(t.strip() for t in text.splitlines()[1:] if t.strip())) for text in re.split(r"(?m)^\s*Tree \d+ ", model.toDebugString)[1:]]


def _tree(lines):
    """One tree of a printed forest."""
    line = next(lines)
    if line.startswith("Predict"):
        return int(float(line.split(":")[1]))
    feature, sign, threshold = re.match(r"If \(feature (\d+) (<=|in|>) (.*)\)", line).groups()
    assert sign == "<=", line
    left = _tree(lines)
    assert next(lines).startswith("Else")
    return FEATURES[int(feature)], float(threshold), left, _tree(lines)


def votes(forest: list, inputs: Column) -> Column:
    """How many trees call the finding with these features (a struct) a secret."""

    def expression(node):
        if isinstance(node, int):
            return F.lit(node)
        name, threshold, left, right = node
        return F.when(inputs[name] <= threshold, expression(left)).otherwise(expression(right))

    total = F.lit(0)
    for tree in forest:
        total = total + expression(tree)
    return total


def scan(docs: DataFrame, forest: list, share: float = SHARE, path: str = "source") -> DataFrame:
    """docs plus candidates (array of start, length, kind, votes, secret) and redacted (text)."""
    text = F.col("text").cast("string")
    names = docs.columns
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in names else F.lit("")
    cut = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), text.alias("_text"), where.alias("_path"), F.coalesce(F.regexp_extract_all(text, F.lit(f"({PATTERN})"), 1), F.array().cast("array<string>")).alias("_found"))
    # a text without candidates needs no second look
    parts = cut.withColumn("_parts", F.when(F.size("_found") > 0, F.split("_text", PATTERN, -1)).otherwise(F.array().cast("array<string>")))
    described = parts.withColumn("_items", F.transform("_found", lambda c, i: _item(c, i)))
    scored = described.withColumn("_items", F.transform("_items", lambda x: F.struct(x["candidate"].alias("candidate"), x["known"].alias("known"), votes(forest, x["inputs"]).alias("votes"))))
    scored = scored.withColumn("_items", F.transform("_items", lambda x: F.struct(x["candidate"].alias("candidate"), F.when(x["known"] == 1, "format").otherwise(F.when(F.regexp_like(x["candidate"], F.lit(f"^{NAMED}")), "assigned").otherwise("token")).alias("kind"), x["votes"].alias("votes"), (x["votes"] >= len(forest) * share).alias("secret"))))
    at = lambda i: F.aggregate(F.slice("_parts", 1, i + 1), F.lit(0), lambda s, p: s + F.length(p)) + F.aggregate(F.slice("_found", 1, i), F.lit(0), lambda s, c: s + F.length(c))
    findings = F.transform("_items", lambda x, i: F.struct(at(i).alias("start"), F.length(x["candidate"]).alias("length"), x["kind"].alias("kind"), x["votes"].alias("votes"), x["secret"].alias("secret")))
    pieces = F.transform("_items", lambda x, i: F.concat(F.when(x["secret"], F.lit(REPLACEMENT)).otherwise(x["candidate"]), F.element_at("_parts", i + 2)))
    redacted = F.when(F.exists("_items", lambda x: x["secret"]), F.concat(F.element_at("_parts", 1), F.array_join(pieces, ""))).otherwise(F.col("_text"))
    return scored.select("_row.*", findings.alias("candidates"), redacted.alias("redacted"))


def _item(candidate: Column, i: Column) -> Column:
    before = F.right(F.element_at("_parts", i + 1), F.lit(NEAR))
    inputs = features(candidate, before, F.col("_path"))
    return F.struct(candidate.alias("candidate"), inputs["known"].alias("known"), F.struct(*[c.alias(name) for name, c in inputs.items()]).alias("inputs"))


def findings_per_document(docs: DataFrame, forest: list) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (start, length, kind, votes), redacted_sha256 of every row."""
    found = scan(docs.select(F.col("doc_id").cast("long"), "text", "source"), forest)
    secrets = F.transform(F.filter("candidates", lambda c: c["secret"]), lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["kind"].alias("kind"), c["votes"].alias("votes")))
    return found.select("doc_id", F.size("candidates").alias("n_candidates"), F.size(secrets).alias("n_secrets"), secrets.alias("secrets"), F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


def redact(docs: DataFrame, forest: list) -> DataFrame:
    """docs with secrets replaced in text, and n_chars of the new text where docs has it."""
    names = docs.columns
    found = scan(docs.select("text", *(["source"] if "source" in names else []), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_doc")), forest)
    new = {"text": F.col("redacted")} | ({"n_chars": F.when(F.col("redacted") == F.col("_doc.text"), F.col("_doc.n_chars")).otherwise(F.length("redacted").cast("long"))} if "n_chars" in names else {})
    return found.select(*[new[n].alias(n) if n in new else F.col(f"_doc.`{n}`") for n in names])
