"""Secret scan: a random forest removes false positives among candidate strings. Native expressions only.

A document is handled within its own row: every long run of key characters, and every value assigned to or
following a secret word whatever its length, is a candidate; each gets features from its characters and their
transitions, the dictionary words in it, path marks and its neighbouring words; the forest is evaluated by array
functions on literals. Nothing is shuffled. The forest is fitted on the driver, from a bounded number of labelled
findings whose candidates and features come from the same expressions. The dictionary, and how likely one letter
follows another, come from the whole words of a public vocabulary.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tokens import vocabulary

#: Labelled findings used for fitting at most.
MAX_LABELLED = 6000
TREES, DEPTH = 24, 7
#: Templates that are one expression.
PART = 6
#: Words of the dictionary, the first of the vocabulary; ends of a whole word there.
WORDS, WORD_END = 3000, "</w>"
THRESHOLD = 0.5
MARK = "[SECRET]"
#: Key characters, marks of secrets and of harmless strings, well-known prefixes.
RUN = "[A-Za-z0-9+/_\\-]{12,}"
#: A run with the text between it and the run before; \\G keeps the search linear in the word.
LED_RUN = f"(?s)\\G(.*?)({RUN})"
GAPS = "[\\x20\\x09-\\x0D]+"
SECRET_WORDS = "password|passwd|pwd|secret|token|api_?key|apikey|access_?key|auth|credential|bearer|private"
#: A secret word's assignment within a word (the mark before the value, the value), a secret word at a word's end, what
#: may stand between it and its value, the value at a word's beginning, and brackets that close behind a value.
ASSIGNED = f"(?i)((?:{SECRET_WORDS})[A-Za-z0-9_\\-]{{0,40}}[\"'`]*[=:]+[\"'`]*)((?<=[\"'`])[^\"'`]+|(?<![\"'`])[^\"'`,;]+)"
NAMED = f"(?i)(?:{SECRET_WORDS})[A-Za-z0-9_\\-]{{0,40}}[\"'`]*[=:]*[\"'`]*$"
BETWEEN = "^[\"'`]*(?:[=:]+>?|is|was)[\"'`]*$"
OPENING = "[\"'`(<\\[{]*"
CLOSING = "[)\\]}>.]+$"
HARMLESS_WORDS = "commit|sha1|sha256|sha512|md5|hash|checksum|digest|integrity|uuid|guid|isbn|doi|phone|card|order|invoice|version|etag|revision|blob|tree|build|ticket|base64"
PREFIXES = "^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk-|sk_live_|xox[abp]-|AIza|eyJ)"
#: A secret word, or a harmless one, whose assignment ends just before a value.
NAMES_IT = f"(?i)(?:{SECRET_WORDS})[A-Za-z0-9_\\-]{{0,40}}[\"'`]*[\\x20]?[=:]+[\\x20\"'`]*$"
HARMLESS_NAMES_IT = f"(?i)(?:{HARMLESS_WORDS}|[?&]v|ref)[A-Za-z0-9_\\-]{{0,40}}[\"'`]*[\\x20]?[=:/\\-]+[\\x20\"'`]*$"
FEATURES = ("length", "transitions", "digits", "uppers", "dictionary", "natural", "hex", "path", "secret_near", "harmless_near", "prefix", "distinct", "assigned", "named", "harmless_named", "word_then_digits")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of characters in the table of transitions: the letters, digits, all others.
KINDS = 28


@dataclass(frozen=True)
class Lexicon:
    """A dictionary and the log-probability of each kind of character after each (row by row)."""

    words: tuple[str, ...]
    follows: tuple[float, ...]

    def coverage(self, value: Column) -> Column:
        """Share of the characters in dictionary words, where a word ends at a capital after a small letter or at what is no letter."""
        parts = F.split(F.translate(F.regexp_replace(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+", " "), UPPER, LOWER), " ")
        known = F.filter(parts, lambda p: p.isin(list(self.words)))
        return F.aggregate(known, F.lit(0), lambda n, p: n + F.length(p)) / F.greatest(F.length(value), F.lit(1)).cast("double")

    def natural(self, value: Column) -> Column:
        """Mean log-probability of a character after the one before it."""
        code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - ord("a")).when(c.between("0", "9"), 26).otherwise(27)
        kinds = F.transform(F.split(F.translate(value, UPPER, LOWER), ""), code)
        table = F.expr(f"array({','.join(f'{v!r}D' for v in self.follows)})")
        pairs = lambda ks: F.aggregate(F.sequence(F.lit(1), F.size(ks) - 1), F.lit(0.0), lambda t, i: t + F.get(table, F.get(ks, i - 1) * KINDS + F.get(ks, i))) / (F.size(ks) - 1)
        return F.get(F.transform(F.array(kinds), lambda ks: F.when(F.size(ks) > 1, pairs(ks)).otherwise(0.0)), 0)


@functools.cache
def lexicon(path: str | None = None, words: int = WORDS) -> Lexicon:
    """From the whole words of ASCII letters in a vocabulary file; the first ``words`` of four letters and more are the dictionary."""
    held = json.loads(Path(path or vocabulary("word_bpe_49k.json")).read_text("utf-8"))["model"]["vocab"]
    whole = [t.removesuffix(WORD_END) for t, _ in sorted(held.items(), key=lambda x: x[1]) if t.endswith(WORD_END)]
    whole = [t for t in whole if t.isascii() and t.isalpha() and len(t) > 2]
    counts = np.ones((KINDS, KINDS))
    for t in whole:
        code = np.frombuffer(t.encode(), np.uint8) - ord("a")
        np.add.at(counts, (code[:-1], code[1:]), 1)
    follows = np.log(counts / counts.sum(axis=1, keepdims=True)).round(6)
    return Lexicon(tuple(t for t in whole if len(t) > 3)[:words], tuple(follows.ravel().tolist()))


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double") / F.greatest(F.length(text), F.lit(1))


def features(word: Column, value: Column, before: Column, two_before: Column, after: Column, known: Lexicon) -> Column:
    """Array of doubles, in the order of FEATURES."""
    lead = F.call_function("substring_index", word, value, F.lit(1))
    near = F.lower(F.concat_ws(" ", F.coalesce(two_before, F.lit("")), F.coalesce(before, F.lit("")), lead))
    around = F.concat_ws(" ", near, F.lower(F.coalesce(after, F.lit(""))))
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    return F.array(
        F.length(value).cast("double"),
        (F.length(runs) - 1) / size,
        _share(value, "[^0-9]"),
        _share(value, "[^A-Z]"),
        known.coverage(value),
        known.natural(value),
        flag(value.rlike("^[0-9a-fA-F]+$") & value.rlike("[a-fA-F]")),
        flag(word.rlike("[/\\\\]|\\.[a-z]|@|://")),
        flag(near.rlike(SECRET_WORDS)),
        flag(around.rlike(HARMLESS_WORDS)),
        flag(value.rlike(PREFIXES)),
        F.size(F.array_distinct(F.split(value, ""))) / size,
        flag(lead.rlike("[=:]") | F.coalesce(before, F.lit("")).rlike("[=:]$")),
        flag(near.rlike(NAMES_IT)),
        flag(near.rlike(HARMLESS_NAMES_IT)),
        flag(value.rlike("^[A-Za-z_\\-]+[0-9]{1,4}$")),
    )


def runs(word: Column, before: Column, two_before: Column, after: Column) -> Column:
    """Array of struct(word, value, b1, b2, a1): every long run of a word, with its context.

    The only run of a word has the whole word and its neighbours as context; one of several has the text since the
    run before it, and that run as the word before it.
    """
    values = F.regexp_extract_all(word, F.lit(LED_RUN), F.lit(2))

    def context(vs: Column) -> Column:
        led = F.transform(F.arrays_zip(F.regexp_extract_all(word, F.lit(LED_RUN), F.lit(1)).alias("head"), vs.alias("value")), lambda r: F.concat(r["head"], r["value"]))
        alone = F.size(vs) == 1
        return F.transform(vs, lambda v, k: F.struct(F.when(alone, word).otherwise(F.get(led, k)).alias("word"), v.alias("value"), F.when(k == 0, before).otherwise(F.get(vs, k - 1)).alias("b1"), F.when(k == 0, two_before).alias("b2"), F.when(k == F.size(vs) - 1, after).alias("a1")))

    return F.get(F.transform(F.array(values), context), 0)


def assigned(word: Column, before: Column, two_before: Column, after: Column) -> Column:
    """Array of struct(word, value, b1, b2, a1, lead): the values that a word assigns to secret words and that aren't one long run.

    lead: the text of the assignment just before the value.
    """
    parts = F.regexp_replace(word, "&(?=[A-Za-z_]{1,40}=)", ";")
    pairs = F.arrays_zip(F.regexp_extract_all(parts, F.lit(ASSIGNED), F.lit(1)).alias("lead"), F.regexp_extract_all(parts, F.lit(ASSIGNED), F.lit(2)).alias("value"))
    cut = F.transform(pairs, lambda p: F.struct(p["lead"].alias("lead"), F.regexp_replace(p["value"], CLOSING, "").alias("value")))
    short = F.filter(cut, lambda p: (p["value"] != "") & ~p["value"].rlike(f"^{RUN}$"))
    return F.transform(short, lambda p: F.struct(F.concat(p["lead"], p["value"]).alias("word"), p["value"].alias("value"), before.alias("b1"), two_before.alias("b2"), after.alias("a1"), p["lead"].alias("lead")))


def candidates(text: Column, known: Lexicon) -> Column:
    """Array of struct(word_pos, value, f, lead, gap). Empty for null.

    Candidates are all long runs of key characters, the values that a word assigns to a secret word and the values in
    the word after a secret word; lead is the text just before one of the latter two, gap says that white space parts
    them.
    """
    words = F.split(text, GAPS)
    is_candidate = lambda w: w.rlike(f"(?i:{SECRET_WORDS})|{RUN}")

    def found(ws: Column) -> Column:
        spots = F.filter(F.transform(ws, lambda w, i: F.when(is_candidate(w), i)), lambda i: i.isNotNull())
        at = lambda i, k: F.when(i + k >= 0, F.get(ws, i + k))
        around = lambda i: (at(i, -1), at(i, -2), at(i, 1))
        fields = lambda i, r, lead, gap: F.struct(i.cast("int").alias("word_pos"), *[r[k].alias(k) for k in ("word", "value", "b1", "b2", "a1")], lead.alias("lead"), F.lit(gap).alias("gap"))
        struct = lambda i, value: F.struct(at(i, 0).alias("word"), value.alias("value"), *[c.alias(k) for k, c in zip(("b1", "b2", "a1"), around(i), strict=True)])

        def following(i: Column) -> Column:
            j = i + F.when(at(i, 1).rlike(BETWEEN), 2).otherwise(1)
            bare = lambda j: F.regexp_replace(F.regexp_extract(F.coalesce(at(j, 0), F.lit("")), f"^{OPENING}([^\"'`,;]+)", 1), CLOSING, "")
            own = F.filter(F.transform(F.array(j), lambda j: fields(j, struct(j, bare(j)), at(j, -1), True)), lambda c: (c["value"] != "") & ~c["value"].rlike(f"^{RUN}$") & ~c["word"].rlike(ASSIGNED))
            return F.when(at(i, 0).rlike(NAMED), own).otherwise(F.slice(own, 1, 0))

        def of(i: Column) -> Column:
            long = F.transform(runs(at(i, 0), *around(i)), lambda r: fields(i, r, F.lit(""), False))
            return F.concat(long, F.transform(assigned(at(i, 0), *around(i)), lambda r: fields(i, r, r["lead"], False)), following(i))

        raw = F.flatten(F.transform(spots, of))
        return F.transform(raw, lambda c: F.struct(c["word_pos"].alias("word_pos"), c["value"].alias("value"), features(c["word"], c["value"], c["b1"], c["b2"], c["a1"], known).alias("f"), c["lead"].alias("lead"), c["gap"].alias("gap")))

    none = F.array().cast("array<struct<word_pos:int,value:string,f:array<double>,lead:string,gap:boolean>>")
    one = F.transform(F.array(words), found)  # binds the split once
    return F.when(text.isNotNull(), F.get(one, 0)).otherwise(none)


@dataclass(frozen=True)
class Forest:
    """Full trees in heap order: feature and bound of each inner node, the share of secrets in each leaf."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    known: Lexicon | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        trees, inner = np.arange(len(self.leaf)), self.bound.shape[1]
        while (node < inner).any():
            node = 2 * node + np.where(x[np.arange(len(x))[:, None], self.feature[trees, node]] <= self.bound[trees, node], 1, 2)
        return self.leaf[trees, node - inner].mean(axis=1)

    def score(self, f: Column) -> Column:
        """The same as an expression over an array of features."""
        trees, inner = self.bound.shape
        depth = (inner + 1).bit_length() - 1
        flat = lambda a, kind: F.expr(f"array({','.join(repr(kind(v)) + ('D' if kind is float else '') for v in a.ravel())})")
        feature, bound, leaf = flat(self.feature, int), flat(self.bound, float), flat(self.leaf, float)

        def tree(t: Column) -> Column:
            step = lambda n, _: 2 * n + F.when(F.get(f, F.get(feature, t * inner + n)) <= F.get(bound, t * inner + n), 1).otherwise(2)
            last = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
            return F.get(leaf, t * (inner + 1) + last - inner)

        return F.aggregate(F.sequence(F.lit(0), F.lit(trees - 1)), F.lit(0.0), lambda total, t: total + tree(t)) / float(trees)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
    """Bootstrap samples, about the square root of the features tried at each node, Gini impurity."""
    rng = np.random.default_rng(seed)
    inner, tried = (1 << depth) - 1, max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    feature, bound, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), 1e300), np.zeros((trees, inner + 1))
    for t in range(trees):
        held = {0: rng.integers(0, len(x), len(x))}
        for node in range(2 * inner + 1):
            own = held.pop(node)
            if node >= inner:
                leaf[t, node - inner] = y[own].mean() if len(own) else 0.0
                continue
            best = (np.inf, 0, 1e300)
            if len(own) and 0 < y[own].sum() < len(own):
                for k in rng.choice(x.shape[1], tried, replace=False):
                    for b in np.unique(np.quantile(x[own, k], np.linspace(0.05, 0.95, 13), method="lower")):
                        low = y[own[x[own, k] <= b]]
                        high = y[own[x[own, k] > b]]
                        if len(low) and len(high):
                            gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (low, high))
                            best = min(best, (gini, int(k), float(b)))
            feature[t, node], bound[t, node] = best[1], best[2]
            near = x[own, best[1]] <= best[2]
            # an unsplit node hands its rows to both sides, so that every leaf has a share
            held[2 * node + 1], held[2 * node + 2] = (own[near], own[~near]) if np.isfinite(best[0]) else (own, own)
    return Forest(feature, bound, leaf)


def labelled_findings(spark: SparkSession, n: int = 4000, seed: str = "findings", templates: Callable[["Parts"], list[tuple]] | None = None) -> DataFrame:
    """text, value, secret: findings in context, made from templates and hashed numbers (the default training set).

    A template: whether it is a secret (1 or 0), the text before the value, the value, the text after it. ``templates``
    takes the place of the default ones, as for tests.
    """
    p = Parts(seed)
    held = (templates or default_templates)(p)
    found = []
    for begin in range(0, len(held), PART):  # in parts, each small enough to be compiled
        own = held[begin : begin + PART]
        kind = F.pmod(F.col("id"), F.lit(len(held))) - begin
        choose = lambda k: F.coalesce(*[F.when(kind == i, F.lit(t[k]) if k == 0 or isinstance(t[k], str) else t[k]) for i, t in enumerate(own)])  # noqa: B023, E731
        rows = spark.range(n).where(kind.between(0, len(own) - 1)).select("id", choose(1).alias("lead"), choose(2).alias("value"), choose(3).alias("tail"), choose(0).alias("secret"))
        text = F.concat(p.word(1), F.lit(" "), p.word(2), F.lit(" "), "lead", "value", "tail", F.lit(" "), p.word(18))
        found.append(rows.select(text.alias("text"), "value", "secret"))
    return functools.reduce(DataFrame.unionByName, found)


class Parts:
    """Random parts of findings, as expressions over id."""

    def __init__(self, seed: str) -> None:
        sha = lambda k: F.sha2(F.concat(F.lit(f"{seed}{k}"), F.col("id").cast("string")), 256)
        base = lambda k: F.translate(F.base64(F.unhex(sha(k))), "+/=", "xYz")
        self.hex, self.hex2, self.mixed, self.mixed2 = sha(""), sha("2"), base(""), base("2")
        self.long = F.concat(base("3"), base("4"))
        self.caps = F.upper(F.translate(F.base64(F.unhex(sha("2"))), "+/=0189", "QRSTUVW"))
        self.digits = F.translate(self.hex, "abcdef", "123456")
        self.letters = F.translate(self.mixed, "0123456789", "qJvKxZwGyB")
        self.uuid = F.concat_ws("-", *[F.substring(self.hex, i, m) for i, m in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    @staticmethod
    def pick(k: int, *options: str) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(options))) + 1).cast("int"))

    def word(self, k: int) -> Column:
        return self.pick(k, "the", "of", "with", "and", "see", "uses", "in", "then", "der", "les", "que", "value", "is", "thing", "erst")

    def noun(self, k: int) -> Column:
        return self.pick(k, "correct", "horse", "battery", "purple", "monkey", "dragon", "hunter", "summer", "Winter", "rabbit", "Sword", "fish", "tiger", "Pepper", "castle", "falcon")

    def syllable(self, k: int) -> Column:
        return self.pick(k, "tion", "er", "che", "wh", "ing", "aux", "lich", "keit", "ment", "on", "ble", "que", "th", "sch", "ver")

    def cut(self, text: Column, least: int, most: int, k: int = 90) -> Column:
        """The first characters of a text, ``least`` to ``most`` of them."""
        return F.substring(text, F.lit(1), F.lit(least) + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most - least + 1)).cast("int"))


def default_templates(p: Parts) -> list[tuple]:
    """Access keys, assigned passwords, quoted tokens, prefixed keys, secrets in URLs, JSON, settings and pairs, phrases, short and
    digitless ones; against them commits, checksums, UUIDs, paths, addresses, card numbers, versions, identifiers, placeholders, prose, names
    of keys, settings, data, and harmless strings in URLs, JSON and settings."""
    at = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    pick, cut, noun = p.pick, p.cut, p.noun
    key = pick(20, "password=", "passwd=", "pwd=", "pwd:", "secret=", "PASSWORD=", "db_password:", "auth_token=", "token=", "access_key=", "api_key=", "token:")
    named = pick(27, "password: ", "pwd: ", "Password: ", "secret: ", "passwd= ", "password is ", "password = ", "token: ")
    sign = pick(26, "&", "!", "#", "%", "$", "*", "@")
    bare = lambda k: pick(k, "secret ", "token ", "private ", "password ", "author ", "authentication ", "credential ")
    strong = pick(50, "0", "1", "2")
    value = F.when(strong == "0", cut(p.hex, 18, 40)).when(strong == "1", cut(p.mixed, 16, 36)).otherwise(cut(p.letters, 20, 36))
    shaped = lambda c: F.when(strong == "0", c).when(strong == "1", F.initcap(c)).otherwise(F.upper(c))
    prose = F.concat(*[p.syllable(k) for k in range(40, 45)], F.lit("ent"))
    page = at("https://", noun(60), ".example.com/", pick(61, "cb", "login", "api/v1/get", "x", "hook"))
    return [
        (1, pick(62, "", "key ", "aws_access_key_id = ", "creds ", "AWS_KEY_ID="), at("AKIA", cut(p.caps, 16, 16)), pick(63, "", ";", ".", ":password=x")),
        (1, "", at("AKIA", cut(p.caps, 16, 16)), ""),
        (1, key, value, ""),
        (1, key, value, pick(64, "", ",", ";", "&user=me")),
        (1, at(pick(4, "token", "secret", "api_key", "password"), ' = "'), value, '"'),
        (1, at('{"', pick(65, "password", "api_key", "clientSecret", "access_token"), '":"'), value, '","user":"me"}'),
        (1, at('{"commit":"', cut(p.hex2, 40, 40), '","token":"'), value, '"}'),
        (1, pick(5, "api_key: ", "apikey= ", "Bearer ", "token: ", "secret: ", "Authorization: Bearer "), value, ""),
        (1, pick(66, "", "export KEY=", "key: ", "use "), at(pick(6, "ghp_", "sk-", "glpat-", "AIza", "xoxb-"), cut(p.mixed, 30, 40)), ""),
        (1, at(page, "?", pick(67, "", "user=me&", "lang=en&"), pick(68, "token=", "access_token=", "api_key=", "secret=", "auth=")), value, pick(69, "", "&lang=en", "#top")),
        (1, at("AWS_KEY_ID=AKIA", cut(p.caps, 16, 16), ";AWS_SECRET="), cut(p.mixed, 30, 40), ""),
        (1, at("AKIA", cut(p.caps, 16, 16), ":password="), cut(p.hex2, 18, 24), ""),
        (1, at("token=", cut(p.hex2, 20, 32), "&secret="), cut(p.hex, 20, 32), ""),
        (1, at(pick(70, "postgres", "https", "redis"), "://", noun(71), ":"), cut(p.mixed, 20, 32), "@db.example.com/main"),
        (1, key, at(noun(21), "-", noun(22), "-", noun(23)), ""),
        (1, key, at(noun(24), cut(p.digits, 1, 3)), ""),
        (1, key, at(noun(24), cut(p.digits, 1, 2), pick(72, "!", "!x", "#1", "$", "")), ""),
        (1, key, at(noun(24), noun(25)), ""),
        (1, key, at(F.initcap(noun(21)), F.initcap(noun(22)), F.initcap(noun(23)), F.initcap(noun(24))), ""),
        (1, key, at(cut(p.mixed, 5, 6), sign, cut(p.mixed2, 4, 6)), ""),
        (1, named, at(noun(24), cut(p.digits, 2, 2)), ""),
        (1, named, at(cut(p.mixed, 5, 5), sign, cut(p.mixed2, 5, 5)), ""),
        (0, pick(8, "commit ", "revision ", "tree ", "blob ", "sha1 ", "in commit: "), cut(p.hex, 40, 40), ""),
        (0, pick(9, "sha256:", "md5:", "etag=", "checksum=", "digest: ", "sha1="), cut(p.hex, 32, 64), ""),
        (0, pick(10, "uuid ", "guid ", "id ", "the ", "id="), p.uuid, ""),
        (0, "", at("/usr/lib/python3/", p.word(11), "/", p.word(12), cut(p.digits, 1, 2), ".py"), ""),
        (0, pick(13, "card ", "order ", "the ", "of ", "and ", "es "), cut(p.digits, 13, 16), ""),
        (0, at(p.word(14), ".", cut(p.digits, 2, 2), "@"), at("mailhost", cut(p.digits, 1, 1)), ".example.com"),
        (0, "", at(pick(15, "getUserById", "ConfigServiceModule", "release-version-", "sample_test_data_", "user_setting_"), cut(p.digits, 1, 3)), ""),
        (0, "", at(shaped(noun(21)), pick(73, "_", "-", ""), F.initcap(noun(22)), pick(74, "Handler", "_count", "-list", "Service")), ""),
        (0, key, at(pick(16, "changeme-", "your_token_here_", "example-value-", "placeholder"), cut(p.digits, 1, 3)), ""),
        (0, "", at("https://www.example.com/page/item/", cut(p.digits, 4, 8)), ""),
        (0, at(page, "?", pick(75, "v=", "commit=", "ref=", "etag=", "build=")), cut(p.hex, 20, 40), pick(76, "", "&lang=en")),
        (0, at("https://", noun(60), ".example.com/", pick(77, "blob/", "commit/", "tree/")), cut(p.hex, 40, 40), "/main.c"),
        (0, at('{"', pick(78, "sha1", "etag", "revision", "checksum"), '":"'), cut(p.hex, 32, 40), '","size":4}'),
        (0, '{"uuid":"', p.uuid, '"}'),
        (0, pick(79, "integrity sha512-", "data:image/png;base64,", "sha512-"), cut(p.long, 60, 80), ""),
        (0, at("https://", noun(80), "-", noun(81), "-user-01:"), "", ""),
        (0, pick(82, "PATH=", "HOST=", "ref=refs/heads/", "branch "), at(noun(83), pick(84, "/", "-", "_"), noun(85), pick(86, "/", "-", "_"), noun(87), cut(p.digits, 1, 2)), ""),
        (0, "", at("2024-05-", cut(p.digits, 2, 2), "T07:08:"), "09Z"),
        (0, pick(17, "version ", "build ", "invoice ", "ticket ", "phone "), cut(p.digits, 12, 14), ""),
        *[(0, "", at(shaped(prose), pick(47, "", ".", ",", "!!")), "")] * 3,
        (0, bare(28), at(p.syllable(40), p.syllable(41), pick(48, "", "s", "ing", "ed")), ""),
        (0, bare(28), p.word(49), ""),
        (0, "", pick(29, "AWS_SECRET_ACCESS_KEY", "github_access_token", "db_password_production", "CLIENT_AUTH_SECRET", "privateKeyPassphrase", "token_expiry_seconds", "authentication"), ""),
        (0, pick(30, "password=", "token:", "secret=", "auth:", "private="), pick(31, "true", "null", "none", "false", "yes", "no", "on", "off"), ""),
        (0, pick(32, "password: ", "token: ", "secret: ", "auth: ", "private: "), pick(33, "true", "null", "none", "string", "false", "12", "user", "default", "a", "the"), ""),
    ]


def train(findings: DataFrame, limit: int = MAX_LABELLED, known: Lexicon | None = None) -> Forest:
    """Fits on at most ``limit`` labelled findings (text, value, secret), the first by a hash of their columns: the candidates of
    the text that are the value. Rows with a null are skipped; without any candidate it is an error."""
    known = known or lexicon()
    rows = findings.where("text IS NOT NULL AND value IS NOT NULL AND secret IS NOT NULL").select(F.explode(candidates(F.col("text"), known)).alias("c"), "value", F.col("secret").cast("double").alias("y"))
    rows = rows.where(F.col("c.value") == F.regexp_replace("value", CLOSING, "")).select("c.f", "y")
    got = rows.orderBy(F.xxhash64("f", "y")).limit(limit).collect()
    if not got:
        raise ValueError("no labelled findings")
    fitted = fit(np.array([r.f for r in got]), np.array([r.y for r in got]))
    return Forest(fitted.feature, fitted.bound, fitted.leaf, known)


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, word_pos, candidate, score, secret: a row per candidate of every document.

    Null and empty texts, and an empty table, have none; repeated rows and null ids are scanned as rows of their
    own; long texts are scanned whole; other columns are ignored. The score is the forest's mean share of secrets.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(candidates(F.col(text_col), forest.known)).alias("c"))
    scored = found.select("doc_id", F.col("c.word_pos").alias("word_pos"), F.col("c.value").alias("candidate"), forest.score(F.col("c.f")).alias("score"))
    return scored.withColumn("secret", F.col("score") >= threshold)


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = THRESHOLD, mark: str = MARK) -> DataFrame:
    """``docs`` with every confirmed secret in the text replaced by ``mark``; all else as it was.

    A long run is replaced wherever it stands, another value where it follows the same text.
    """
    text = F.col(f"`{text_col}`")
    sure = F.filter(candidates(text, forest.known), lambda c: forest.score(c["f"]) >= threshold)
    # values behind a gap first, then the longest, so that no value is cut by another that it contains
    secrets = F.sort_array(F.array_distinct(F.transform(sure, lambda c: F.struct(c["gap"].alias("gap"), F.length(c["value"]).alias("size"), c["value"].alias("value"), c["lead"].alias("lead")))), asc=False)
    literal = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    quoted = mark.replace("\\", "\\\\").replace("$", "\\$")

    def hide(t: Column, s: Column) -> Column:
        apart = F.regexp_replace(t, F.concat(F.lit("("), literal(s["lead"]), F.lit(f"{GAPS}{OPENING})"), literal(s["value"])), F.lit(f"$1{quoted}"))
        return F.when(s["gap"], apart).otherwise(F.replace(t, F.concat(s["lead"], s["value"]), F.concat(s["lead"], F.lit(mark))))

    return docs.withColumn(text_col, F.when(text.isNotNull(), F.aggregate(secrets, text, hide)))
