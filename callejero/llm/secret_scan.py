"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are PEM private keys, dotted tokens (three base64 parts), values assigned to a key word
(``password = "..."``, ``pwd=...``, ``bearer ...``; four characters or more, whatever they are) and
runs of at least 16 letters, digits and ``_ + / -`` with padding. Each is described by its length,
its character classes, the transitions between its classes and letters, how much of it dictionary
words cover, whether it stands in a path, and its neighbouring words. A forest trained on labelled
findings tells secrets from look-alikes (digests, commit ids, UUIDs, file names, order numbers,
long words, placeholders). The trained trees are turned into SQL expressions, so scoring is plain
DataFrame work on the main path: row-local, no Python, no shuffle.

The dictionary is the ``DICTIONARY`` most frequent lower-case words of a public tokenizer's
vocabulary file, whose path is a parameter; letter transitions are counted on the same words.
``labelled_examples`` builds the default training findings by rule (a bounded number, documented
by ``EXAMPLES``), each with the ``kind`` of rule that made it, so that kinds can be held out; a
table of real findings with the same columns can take their place.

Defined cases: null and empty texts have no findings; equal secrets in one text are findings of
their own, told apart by ``start``; of overlapping candidates the one that starts first counts
(a PEM key or dotted token before an assigned value before a run); repeated rows give repeated
findings; null ids stay null; other columns are ignored. ``start`` counts characters from 0.
"""

from __future__ import annotations

import json
import math
import random
from functools import cache

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES, TREES, DEPTH, SEED = 4000, 24, 7, 11
DICTIONARY = 4000
CONTEXT = 48

#: Word lists of the patterns and features.
KEY_WORDS = "token|secret|passw(?:or)?d|passwd|pwd|api.?key|access.?key|auth(?!or)|credentials?|private.?key"
OTHER_WORDS = "commit|sha|digest|checksum|md5|uuid|guid|etag|order|invoice|isbn|version|build|file|image|hash|ref|session|track"
RUN = r"[A-Za-z0-9_+/\-]"
ASSIGNED = rf"(?i:{KEY_WORDS})\w{{0,8}}[\"'\]]{{0,2}}\s{{0,3}}(?::?=>?|:|\bis\b)\s{{0,3}}|(?i:bearer)\s{{1,3}}"
VALUE = r"(?:(?<=[\"'])[^\"'\n]{4,200}+(?=[\"'])|[^\s\"'`<>,;()]{4,}+)"
KEY_LINE = "KEY(?: BLOCK)?-----"
PEM = rf"-----BEGIN (?:[A-Z]{{2,12}} ){{0,2}}PRIVATE {KEY_LINE}(?:[\s\S]{{1,20000}}?-----END (?:[A-Z]{{2,12}} ){{0,2}}PRIVATE {KEY_LINE}|[^-]*+)"
DOTTED = r"eyJ(?<![A-Za-z0-9_.\-]eyJ)[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]{5,}+"
PLAIN = rf"{PEM}|{DOTTED}|(?<!{RUN}){RUN}{{16,}}+={{0,2}}"
#: For texts that assign something to a key word; the looking back costs too much for all others.
FULL = rf"{PEM}|{DOTTED}|(?<=[=:>\s\"'])(?<=(?:{ASSIGNED})[\"']?)(?<!\w)(?![=:>\s\"']){VALUE}|(?<!{RUN}){RUN}{{16,}}+={{0,2}}"
FEATURES = (
    "length", "digits", "upper", "lower", "signs", "changes", "distinct", "vowels", "hex", "dashes", "spaces", "letters", "dictionary", "path", "key_word", "other_word", "assigned", "quoted", "at_sign",
    "pem", "dotted", "known",
)


@cache
def dictionary(path: str, most: int = DICTIONARY) -> tuple[str, ...]:
    """The first words of four letters or more in a tokenizer's vocabulary, which lists merged pieces by falling frequency."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (t[1:] for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t[0] == "\u0120")
    return tuple([w for w in words if len(w) >= 4 and w.isascii() and w.isalpha() and w.islower()][:most])


def any_word(words: tuple[str, ...]) -> str:
    """One pattern for all words, longest first, with common beginnings of two letters written once."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        groups.setdefault(w[:2], []).append(w[2:])
    return "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in sorted(groups.items()))


def letter_pairs(words: tuple[str, ...]) -> list[float]:
    """Log shares of each letter's followers in the words, 26 x 26."""
    n = [[0.5] * 26 for _ in range(26)]
    for w in words:
        for a, b in zip(w, w[1:]):
            n[ord(a) - 97][ord(b) - 97] += 1
    return [math.log(x / sum(row)) for row in n for x in row]


def findings(docs: DataFrame, ident: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, candidate, before, after of every candidate."""
    d = docs.select(F.col(ident).alias("doc_id"), F.col(text_col).alias("_t"), F.col(text_col).rlike(ASSIGNED).alias("full"))
    d = d.select("doc_id", "_t", "full", F.when(F.col("full"), F.regexp_extract_all("_t", F.lit(FULL), F.lit(0))).otherwise(F.regexp_extract_all("_t", F.lit(PLAIN), F.lit(0))).alias("c"))
    between = F.when(F.size("c") == 0, None).when(F.col("full"), F.split("_t", FULL, -1)).otherwise(F.split("_t", PLAIN, -1))
    d = d.select("doc_id", "c", between.alias("between"))
    # An outer explode, as the filter that Spark infers from a plain one would repeat the search.
    d = d.select("doc_id", "c", "between", F.posexplode_outer("c").alias("i", "candidate")).where("candidate IS NOT NULL")
    start = F.expr("length(array_join(slice(between, 1, i + 1), '')) + length(array_join(slice(c, 1, i), ''))")
    return d.select("doc_id", start.cast("long").alias("start"), "candidate", F.right(F.expr("between[i]"), F.lit(CONTEXT)).alias("before"), F.left(F.expr("between[i + 1]"), F.lit(CONTEXT)).alias("after"))


def described(found: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """The findings with one double for each of FEATURES."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda cond: cond.cast("double")
    pairs = F.array(*map(F.lit, letter_pairs(words)))
    signs = F.split(F.lower(c), "")
    number = lambda x: F.ascii(x) - 97
    letter = lambda x: number(x).between(0, 25)
    # Two characters that are not both letters count like a rare pair.
    scores = F.zip_with(F.slice(signs, 1, n - 1), F.slice(signs, 2, n), lambda x, y: F.when(letter(x) & letter(y), F.get(pairs, (number(x) * 26 + number(y)).cast("int"))).otherwise(-6.0))
    values = {
        "length": n.cast("double"),
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "signs": share(r"[^A-Za-z0-9\s]"),
        "changes": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "vowels": share("[aeiouAEIOU]"),
        "hex": flag(c.rlike("^[0-9a-fA-F]+$")),
        "dashes": share("-"), "spaces": share(r"\s"),
        "letters": F.when(n > 1, F.aggregate(scores, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(-6.0))) / n).otherwise(-6.0),
        "dictionary": (n - F.length(F.regexp_replace(F.lower(c), any_word(words), ""))) / n,
        "path": flag(before.rlike(r"(://[^\s]*|[/\\.])$") | after.rlike(r"^(\.[A-Za-z]{2,4}\b|/)") | c.contains("/")),
        "key_word": flag(before.rlike(rf"(?:{ASSIGNED})[\"']?$") | F.lower(before).rlike(rf"({KEY_WORDS})[^a-z]*$")),
        "other_word": flag(F.lower(before).rlike(rf"({OTHER_WORDS})[^a-z]*$")),
        "assigned": flag(before.rlike(r"[=:]>?\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "at_sign": flag(after.startswith("@") | before.endswith("@")),
        "pem": flag(c.startswith("-----BEGIN")),
        "dotted": flag(c.rlike(f"^{DOTTED}$")),
        "known": flag(c.rlike("^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|rk_live_|xox[abprs]-|glpat-|AIza|ya29)")),
    }
    return found.select("*", *[values[f].cast("double").alias(f) for f in FEATURES])


HEX, BASE62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class Maker:
    """Findings made by rule: (before, candidate, after) of one of KINDS."""

    def __init__(self, words: tuple[str, ...], seed: int) -> None:
        self.rng, self.words = random.Random(seed), words

    def take(self, letters: str, least: int, most: int | None = None) -> str:
        return "".join(self.rng.choice(letters) for _ in range(self.rng.randint(least, most or least)))

    def some(self, *things):
        return self.rng.choice(things)

    def word(self) -> str:
        return self.rng.choice(self.words)

    def prose(self, least: int = 0) -> str:
        return "".join(f"{self.word()} " for _ in range(self.rng.randint(least, 5)))

    def assigned(self, body: str, lead: str | None = None) -> tuple[str, str, str]:
        key = lead or self.some("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "TOKEN", "API_KEY", "SECRET_KEY", "private_key", "credential")
        sign = self.some(" = ", "=", ": ", ":", " is ", " := ", '": ')
        quote = self.some('"', '"', "'", "")
        return self.prose() + self.some("", "my_", "DB_", "aws_") + key + sign + quote, body, quote + self.some("", "\n", " ", ";") + self.prose()

    def alone(self, body: str) -> tuple[str, str, str]:
        return self.prose(), body, self.some("", " ", "\n", ", ") + self.prose()

    # secrets
    def s_hex(self):
        return self.assigned(self.take(HEX, self.some(16, 24, 32, 40, 48, 64)))

    def s_base62(self):
        return self.assigned(self.take(BASE62, 10, 64))

    def s_base64(self):
        return self.assigned(self.take(BASE62 + "+/", 22, 80) + self.some("", "=", "=="))

    def s_cloud_id(self):
        body = self.some("AKIA", "ASIA") + self.take("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
        return self.alone(body) if self.rng.random() < 0.6 else self.assigned(body)

    def s_prefixed(self):
        body = self.some("ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-") + self.take(BASE62, 20, 40)
        return self.alone(body) if self.rng.random() < 0.6 else self.assigned(body)

    def s_password(self):
        body = self.take(BASE62 + "!@#$%^&*-_?", 6, 20) + self.take("0123456789!@#$", 1, 2)
        return self.assigned(body, self.some("password", "passwd", "pwd", "Password", "secret"))

    def s_word_password(self):
        body = self.some(lambda: self.word() + self.take("0123456789", 1, 4) + self.word() + self.take("0123456789!", 1, 3), lambda: self.word().title() + self.take("0123456789", 2, 4) + self.some("", "!", "#"))()
        return self.assigned(body, self.some("password", "passwd", "pwd", "secret"))

    def s_phrase(self):
        body = self.some("-", "-", "_", " ", ".").join(self.word() for _ in range(self.rng.randint(3, 6)))
        before, body, after = self.assigned(body, self.some("password", "passwd", "pwd", "secret", "passphrase password"))
        return (before if before[-1] in "\"'" else before.rstrip() + ' "'), body, '"' + after.lstrip("\"'")

    def s_pem(self):
        kind = self.some("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED ")
        lines = "\n".join(self.take(BASE62 + "+/", 64) for _ in range(self.rng.randint(2, 20)))
        return self.alone(f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----")

    def s_dotted(self):
        body = "eyJ" + self.take(BASE62, 15, 40) + ".eyJ" + self.take(BASE62, 20, 90) + "." + self.take(BASE62 + "_-", 30, 60)
        return self.some(self.alone, self.assigned, lambda b: ("Authorization: Bearer ", b, "\n"))(body)

    # look-alikes
    def n_digest(self):
        body = self.take(HEX, self.some(32, 40, 64))
        return self.prose() + self.some("commit", "sha256", "sha1", "checksum", "md5", "etag", "build", "image", "hash", "ref", "digest") + self.some(" ", ": ", "=", " = ", "/"), body, " " + self.prose()

    def n_bare_digest(self):
        return self.alone(self.take(HEX, self.some(16, 32, 40, 64)))

    def n_uuid(self):
        body = "-".join(self.take(HEX, k) for k in (8, 4, 4, 4, 12))
        return self.prose() + self.some("", "id ", "uuid: ", "session=", "request id: "), body, " " + self.prose()

    def n_url(self):
        body = self.some("-", "/", "_").join(self.word() for _ in range(self.rng.randint(3, 6))) + self.some("", f"-{self.rng.randint(1, 2030)}")
        return self.prose() + "https://" + self.some("www.", "") + self.word() + ".example.com/", body, self.some(".html", "/", "", ".png") + " " + self.prose()

    def n_file(self):
        body = "_".join(self.word() for _ in range(self.rng.randint(3, 5))) + self.some("", f"_{self.rng.randint(1, 99)}_v{self.rng.randint(1, 9)}")
        return self.alone(body)

    def n_number(self):
        return self.alone(f"{self.some('INV', 'ORD', 'PO', 'SKU')}-{self.rng.randint(2000, 2030)}-{self.take('0123456789', 6, 12)}")

    def n_digits(self):
        return self.alone(self.take("0123456789", 16, 26))

    def n_mail(self):
        return self.prose(), self.word() + self.take("0123456789", 2, 14) + self.some("", "_") + self.word(), "@example.com " + self.prose()

    def n_long_word(self):
        return self.alone("".join(self.word() for _ in range(self.rng.randint(3, 6))))

    def n_placeholder(self):
        body = self.some("None", "null", "changeme", "required", "optional", "string", "your_token_here", "your-api-key", "xxxxxxxx", "********", "${TOKEN}", "process.env.SECRET", "os.environ", "true", "false", "$(cat", "hidden", "[redacted]")
        return self.assigned(body)

    def n_sentence(self):
        body = self.word()
        before = self.prose() + self.some("the password is ", "the token is ", "this secret is ", "auth: ", "a bearer ", "Password: ", "credentials: ")
        return before, body, " " + self.prose(2)

    def n_code(self):
        return self.assigned(self.word() + self.some(".", "_", "::") + self.word() + self.some("", "()", "[0]"))


#: The rules of Maker, secrets first.
KINDS = tuple(sorted((m for m in vars(Maker) if m[:2] in ("s_", "n_")), key=lambda m: (m[0] == "n", m)))


def labelled_examples(spark: SparkSession, words: tuple[str, ...], n: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    """before, candidate, after, label, kind: findings made by rule, half of them secrets."""
    maker = Maker(words, seed)
    sides = [[k for k in KINDS if k[0] == side] for side in "sn"]
    rows = []
    for i in range(n):
        kinds = sides[i % 2]
        kind = kinds[i // 2 % len(kinds)]
        before, body, after = getattr(maker, kind)()
        rows.append((before[-CONTEXT:], body, after[:CONTEXT], 1 - i % 2, kind))
    return spark.createDataFrame(rows, "before string, candidate string, after string, label int, kind string")


def flattened(trees: list) -> dict[str, list]:
    """Trained trees as one table of nodes: feature (-1: leaf), threshold, left, right, share of secrets; and the roots."""
    table: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "share": [], "roots": []}

    def add(node) -> int:
        at = len(table["feature"])
        for column in ("feature", "threshold", "left", "right", "share"):
            table[column].append(0)
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            table["feature"][at], table["share"][at] = -1, stats[1] / sum(stats)
        else:
            split = node.split()
            table["feature"][at], table["threshold"][at] = split.featureIndex(), split.threshold()
            table["left"][at], table["right"][at] = add(node.leftChild()), add(node.rightChild())
        return at

    table["roots"] = [add(tree._call_java("rootNode")) for tree in trees]
    return table


def train(labelled: DataFrame, words: tuple[str, ...], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> dict[str, list]:
    """The forest as a table of nodes, from (before, candidate, after, label)."""
    rows = described(labelled, words).coalesce(1).select(*FEATURES, F.col("label").cast("double").alias("label"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(rows)
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    return flattened(model.trees)


def forest_score(forest: dict[str, list], values: str, depth: int = DEPTH) -> Column:
    """The mean share of secrets in the leaves that the array ``values`` of features falls in."""
    arrays = {k: F.array(*[F.lit(float(x) if k in ("threshold", "share") else x) for x in v]) for k, v in forest.items()}
    at = lambda name, node: F.get(arrays[name], node)
    step = lambda node, _: F.when(at("feature", node) < 0, node).otherwise(F.when(F.get(F.col(values), at("feature", node)) <= at("threshold", node), at("left", node)).otherwise(at("right", node)))
    leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step)
    return F.aggregate(arrays["roots"], F.lit(0.0), lambda total, root: total + at("share", leaf(root))) / len(forest["roots"])


def judged(found: DataFrame, forest: dict[str, list], words: tuple[str, ...]) -> DataFrame:
    """The findings and their score."""
    d = described(found, words).select(*found.columns, F.array(*FEATURES).alias("_f"))
    # A generator keeps filters on the score from moving below it and repeating its work.
    return d.select(*found.columns, F.inline(F.array(F.struct(F.round(forest_score(forest, "_f"), 9).alias("score")))))


def held_out(spark: SparkSession, words: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    """kind, n, called: of each kind of findings made by rule, how many a forest calls secrets that saw none of that kind."""
    rows, out = labelled_examples(spark, words), []
    for kind in KINDS:
        forest = train(rows.where(F.col("kind") != kind), words)
        called = judged(rows.where(F.col("kind") == kind), forest, words)
        out.append(called.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("called")).first())
    return spark.createDataFrame(out, "kind string, n long, called long")


def scan(docs: DataFrame, words: tuple[str, ...], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, candidate, score, is_secret of every candidate."""
    forest = train(labelled if labelled is not None else labelled_examples(docs.sparkSession, words), words)
    d = judged(findings(docs), forest, words)
    d = d.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), "candidate", "score")
    return d.withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with every secret of ``found`` (doc_id, candidate, is_secret) replaced by ``<SECRET>``.

    The distinct secrets of a document are gathered (its own text bounds them) and cut out one after
    another, longest first.
    """
    secrets = found.where("is_secret").select("doc_id", "candidate").distinct()
    lists = secrets.groupBy("doc_id").agg(F.collect_list("candidate").alias("_cj_secrets")).withColumnRenamed("doc_id", "_cj_id")
    d = docs.join(lists, docs["doc_id"].eqNullSafe(F.col("_cj_id")), "left")
    by_length = F.expr("array_sort(_cj_secrets, (a, b) -> length(b) - length(a))")
    clean = F.aggregate(by_length, F.col("text"), lambda t, s: F.replace(t, s, F.lit("<SECRET>")))
    text = F.when(F.col("_cj_secrets").isNull(), F.col("text")).otherwise(clean)
    return d.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
