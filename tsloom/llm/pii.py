"""Personal data: candidate spans from high-recall generators, judged by gradient-boosted trees.

Two kinds of spans come out. Base spans follow four fixed patterns and always stay. The method's own spans start as
candidates of looser generators (obfuscated addresses, spaced or dotted numbers, local telephone forms), which may
overlap each other and the base spans. A fifth kind, secret, has candidates only: values assigned to names such as token or
password, long runs of letters and digits, private keys in armour and passwords in URLs. Each candidate gets format features
(digits, separators, groups, Luhn, entropy) and context features (cue words nearby, an assignment before it); Spark ML's gradient-boosted trees, trained here on candidates from generated
sentences, give a margin; a per-kind threshold, set on held-out generated candidates for a precision of PRECISION,
selects; of overlapping selected candidates the one with the highest probability stays, and one that overlaps a base
span is dropped, since that span stays anyway.

Nulls and odd input: null texts count as empty. Rows are independent, repeated and null ids included. Offsets count
code points, ends are exclusive. Empty tables give empty results. Every pattern is matched in time linear in the text.
"""

from __future__ import annotations

import collections
import math
import random
import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone"]
#: All kinds: those of the base patterns, then what only the method finds.
ALL_KINDS = [*KINDS, "secret"]
#: Sentences generated for training, and the share held out to set thresholds.
TRAIN_SENTENCES, HELD_OUT = 8000, 0.3
PRECISION = 0.98
SEED = 7
#: Characters of context on either side that features see.
CONTEXT = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_HEX = frozenset("0123456789abcdefABCDEF")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four fixed patterns, by kind, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            done = m.end()
            out.append(("email", a, done))
        else:
            done = max(done, at + 1)  # what was looked at need not be looked at again
        at = text.find("@", done)
    if not re.search("[0-9]", text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: High-recall generators of candidates.
GENERATORS = {
    "email": re.compile(r"\b[A-Za-z0-9][\w.+-]{0,63}\s?(?:@|\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[A-Za-z0-9-]{1,63}){1,4}\b", re.A),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(dot\))\s?[0-9]{1,3}){3}(?![\w])", re.A),
    "card": re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ._/-]{0,3}[0-9]{2,6}){2,5}(?![0-9])"),
    "phone": re.compile(r"(?<![\w.])(?:\+|00|\()?[0-9][0-9() ./-]{5,20}[0-9](?![\w])", re.A),
}
_NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|api[_-]?key|(?:access|private|secret|session)[_-]?key|bearer)"
#: Secrets; where there is a group, it is the secret.
SECRETS = [
    re.compile(_NAMES + r"[A-Za-z0-9_-]{0,20}[\"']?\s{0,3}(?:[:=]|:=|=>|\bis\b)\s{0,3}[\"']?([^\s\"'<>,;]{6,})", re.I | re.A),
    re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+=*+(?![A-Za-z0-9_+/=-])"),
    re.compile(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----.*?(?:-----END [A-Z ]{0,32}PRIVATE KEY-----|\Z)", re.S),
    re.compile(r"://[^\s/:@]{1,64}:([^\s/@]{3,64})@"),
]
_ASSIGNED = re.compile(_NAMES + r"[A-Za-z0-9_-]{0,20}[\"']?\s{0,3}(?:[:=]|:=|=>|\bis\b)\s{0,3}[\"']?$", re.I | re.A)
#: A value set as a password, which may be any word.
_PASSWORD = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd)[\"']?\s{0,3}=\s{0,3}[\"']?$", re.I | re.A)
#: Last labels of common domains.
_TOP = frozenset("com org net edu gov mil int info io co de fr es it nl uk eu ch at be pl ru us ca au jp cn in br se no dk fi".split())
_LAST = re.compile(r"[A-Za-z0-9-]+$", re.A)
_PREFIXED = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk[-_]|pk_live|AIza|eyJ|-----BEGIN)")
#: Words near a span that speak for its kind, or against all kinds.
CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "dial"),
    "secret": ("secret", "token", "key", "password", "credential", "login", "auth"),
    "": ("version", "isbn", "order", "price", "page", "total", "date", "section", "id", "commit", "checksum", "sha", "digest", "hash", "uuid", "file"),
}
FEATURES = ["kind", "length", "digits", "letters", "separators", "spaces", "groups", "longest_group", "shortest_group", "luhn", "octets", "plus", "parens", "at_sign", "obfuscated", "leading", "cue", "counter_cue", "word_before", "word_after", "entropy", "assigned", "prefixed", "hex", "top_domain", "password", "spaced_at", "dots"]


def features(kind: str, text: str, a: int, b: int) -> list[float]:
    s, near = text[a:b], text[max(0, a - CONTEXT) : a].lower()
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in collections.Counter(s).values())
    around = near + " " + text[b : b + CONTEXT].lower()
    digits = re.sub("[^0-9]", "", s)
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    cue = lambda k: float(any(re.search(rf"\b{w}", around) for w in CUES[k]))
    return [
        float(ALL_KINDS.index(kind)), float(b - a), float(len(digits)), float(sum(c.isalpha() for c in s)), float(sum(not c.isalnum() and not c.isspace() for c in s)), float(sum(c.isspace() for c in s)),
        float(len(groups)), float(max(groups)), float(min(groups)), float(len(digits) > 11 and luhn(digits)), float(len(groups) == 4 and all(int(g) < 256 for g in re.findall("[0-9]+", s) if len(g) < 4) and max(groups) < 4),
        float(s[0] == "+" or s[:2] == "00"), float("(" in s), float("@" in s), float(bool(re.search(r"[\[({]?\b(at|dot)\b|\[\.\]", s))), float(int(s[0]) if s[0].isdigit() and s[0].isascii() else -1), cue(kind), cue(""),
        float(a > 0 and text[a - 1].isalnum()), float(b < len(text) and text[b].isalnum()),
        entropy, float(bool(_ASSIGNED.search(text[max(0, a - 2 * CONTEXT) : a]))), float(bool(_PREFIXED.match(s))), float(not set(s) - _HEX),
        float(bool((m := _LAST.search(s)) and m[0].lower() in _TOP)), float(bool(_PASSWORD.search(text[max(0, a - CONTEXT) : a]))), float(" at " in s), float(s.count(" dot ") + s.count(".")),
    ]


def candidates(text: str) -> list[tuple[str, int, int, list[float]]]:
    """Spans that some generator proposes, also overlapping ones, with their features."""
    kinds = KINDS[1:] if re.search("[0-9]", text) else []
    if "@" in text or " at " in text or re.search(r"[(\[{]at[)\]}]", text):  # one of these is in all that the generator takes
        kinds = ["email", *kinds]
    found = [(k, *m.span()) for k in kinds for m in GENERATORS[k].finditer(text)]
    # a run counts only with letters and digits
    secrets = {m.span(m.lastindex or 0) for g in SECRETS for m in g.finditer(text) if g is not SECRETS[1] or (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))}
    return [(k, a, b, features(k, text, a, b)) for k, a, b in [*found, *(("secret", *x) for x in sorted(secrets))]]


def training_rows(n: int = TRAIN_SENTENCES, seed: int = SEED) -> list[tuple[str, float, bool, list[float]]]:
    """(kind, label, held out, features) of the candidates in n generated sentences, half of which hold personal data."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        head = rng.choice("345") + num(14)
        d = head + next(x for x in "0123456789" if luhn(head + x))
        sep = rng.choice(["", " ", "-", ".", " - "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = rng.choice([("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" @ ", ".")])
        local = rng.choice([f"{word()}.{num(2)}", word(), f"{word()}_{word()}", f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}-{word()}"])
        host = rng.choice([f"{word()}{rng.randint(1, 9)}", word(), f"{word()}-{word()}", f"{word()}{dot}{word()}"])
        return f"{local}{at}{host}{dot}{rng.choice([*sorted(_TOP), 'com', 'org', 'net', 'com', 'org', 'net'])}"

    def ip() -> str:
        return rng.choice([".", "[.]", " . "]).join(str(rng.randint(1, 255)) for _ in range(4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"00{rng.randint(1, 99)} {a} {b} {c}", f"0{a[:2]}/{b}{c}", f"{a}-{b}-{c}"])

    mixed = lambda k, letters: "".join(rng.choice(letters) for _ in range(k))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ("token", "password", "passwd", "api_key", "apikey", "secret", "client_secret", "access_key", "auth_token", "private_key", "SECRET_KEY", "DB_PASSWORD", "Bearer")

    def secret() -> tuple[str, str]:
        """What stands before the secret, and the secret."""
        form = rng.randrange(6)
        value = rng.choice([mixed(rng.choice([32, 40, 64]), "0123456789abcdef"), mixed(rng.randint(20, 44), alnum), mixed(rng.randint(24, 64), alnum + "+/"), mixed(rng.randint(8, 16), alnum + "!#%&*"), word() + num(3)])
        if form == 0:
            return "", rng.choice(["AKIA", "ghp_", "xoxb-", "sk_live_", "AIza", "glpat-", "eyJ"]) + mixed(rng.randint(16, 40), alnum)
        if form == 1:
            head = rng.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----"
            return "", f"-----BEGIN {head}\n" + "\n".join(mixed(64, alnum + "+/") for _ in range(rng.randint(1, 6))) + f"\n-----END {head}"
        if form == 2:
            return f"https://{word()}:", value if len(value) < 40 else value[:20]
        if form == 3 and rng.random() < 0.5:  # any word may be a password
            return rng.choice(["password", "passwd", "db_password", "pwd", "PASSWORD", "passphrase"]) + rng.choice(["=", " = ", "=\""]), word() + word() + rng.choice(["", word(), num(2)])
        return rng.choice(names) + rng.choice([" = ", "=", ": ", " = \"", "=\"", "\": \"", ": '", " is "]), value

    def harmless() -> str:
        if rng.random() < 0.5:  # what looks like a secret
            return rng.choice([
                f"commit {mixed(40, '0123456789abcdef')}", f"sha256 {mixed(64, '0123456789abcdef')}", f"uuid {mixed(8, '0123456789abcdef')}-{mixed(4, '0123456789abcdef')}-4{mixed(3, '0123456789abcdef')}-a{mixed(3, '0123456789abcdef')}-{mixed(12, '0123456789abcdef')}",
                f"{word()}_{word()}_{word()}_{num(2)}_{word()}", f"{word()}-{word()}-{word()}-{num(4)}", f"/{word()}/{word()}/{word()}{num(1)}/{word()}", *[rng.choice([n for n in names if "pass" not in n.lower()]) + rng.choice([": ", " is ", " = ", "="]) + word() + rng.choice(["", word(), "()", "." + word()]) for _ in range(3)], rng.choice(["password", "passwd", "passphrase"]) + rng.choice([" is ", ": "]) + word() + rng.choice(["", word()]),
            ])
        return rng.choice([
            f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}.{rng.randint(256, 9999)}", f"{num(3)}.{num(3)}.{num(3)}", num(rng.choice([6, 8, 9, 11, 13, 16])),
            f"{num(4)} {num(4)} {num(4)} {num(4)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}/{num(2)}/{num(4)} {num(2)}", f"{word()} at {word()} dot {word()}", f"{word()} at {word()} . {word()}", f"meet at {num(2)}.{num(2)}", f"{num(4)}-{num(4)}",
        ])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    rows = []
    for i in range(n):
        kind = rng.choice([*ALL_KINDS, "", "", "", ""])
        lead, told = secret() if kind == "secret" else ("", makers[kind]() if kind else harmless())
        cue = rng.choice([*CUES[kind], *[word()] * 5])
        before = " ".join(word() for _ in range(rng.randint(1, 6))) + f" {cue} " + lead
        text = before + told + ('"' if lead.endswith('"') else f"@{word()}/" if lead.endswith(":") else "") + " " + " ".join(word() for _ in range(rng.randint(1, 6)))
        a, b = len(before), len(before) + len(told)
        held = rng.random() < HELD_OUT
        for k, x, y, f in candidates(text):
            rows.append((k, float(k == kind and x <= a + 1 and y >= b - 1 and y - x <= b - a + 6), held, f))
    return rows


def train(spark: SparkSession) -> tuple[GBTClassificationModel, dict[str, float]]:
    """Boosted trees, and for each kind the least probability at which held-out precision is PRECISION (2: never)."""
    df = spark.createDataFrame(training_rows(), "kind string, label double, held boolean, f array<double>").withColumn("features", array_to_vector("f"))
    gbt = GBTClassifier(maxIter=12, maxDepth=5, stepSize=0.3, seed=SEED, checkpointInterval=-1)
    model = gbt.fit(df.where(~F.col("held")).coalesce(1))
    least = {}
    scored = model.transform(df.where("held")).select("kind", "label", vector_to_array("probability")[1].alias("p")).collect()
    for k in ALL_KINDS:
        hits = n = 0
        least[k] = 2.0
        for r in sorted((r for r in scored if r.kind == k), key=lambda r: (-r.p, r.label)):
            n += 1
            hits += r.label
            if hits >= PRECISION * n and r.p >= 0.5:
                least[k] = r.p
    return model, least


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([*_SPAN.fields, T.StructField("f", T.ArrayType(T.DoubleType()))])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW_FOUND = pa.struct([*_ARROW_SPAN, ("f", pa.list_(pa.float64()))])


def propose(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, but with base (array of spans) and proposed (array of candidates with features)."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in (text_col.lower(), "base", "proposed")]
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            base, more = [], []
            for t in b.column(b.schema.get_field_index(text_col)):
                s = t.as_py() or ""
                base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base_spans(s)])
                more.append([dict(zip(("kind", "start", "end", "f"), x, strict=True)) for x in candidates(s)])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(base, pa.list_(_ARROW_SPAN)), pa.array(more, pa.list_(_ARROW_FOUND))], names=[*names, "base", "proposed"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("base", T.ArrayType(_SPAN)), T.StructField("proposed", T.ArrayType(_FOUND))]))


def _joined(spans: Column) -> Column:
    """Spans by kind as listed, then start, as kind:start:end, comma-joined."""
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, rank)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, but with base, extra (arrays of spans: of the fixed patterns, of the model) and spans (both).

    The model's trees run in a pandas UDF, as nested tuples, over the few candidates of each row that lie beside the base spans."""
    model, least = train(docs.sparkSession)
    out = propose(docs, text_col)
    free = lambda a, b: (a["end"] <= b["start"]) | (b["end"] <= a["start"])
    # a candidate on top of a base span changes nothing
    loose = F.filter("proposed", lambda c: F.forall("base", lambda b: free(b, c)))
    out = out.withColumn("proposed", loose)
    trees, weights = _trees(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def margin(found):
        import pandas as pd

        return pd.Series([[sum(w * _walk(t, c["f"]) for t, w in zip(trees, weights, strict=True)) for c in row] for row in found])

    scored = out.withColumn("margin", F.when(F.size("proposed") > 0, margin("proposed")).otherwise(F.array().cast("array<double>")))
    bound = F.create_map(*[x for k in ALL_KINDS for x in (F.lit(k), F.lit(least[k]))])
    rows = F.zip_with("proposed", "margin", lambda c, m: F.struct((-1.0 / (1.0 + F.exp(-2.0 * m))).alias("p"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    good = F.array_sort(F.filter(rows, lambda c: -c["p"] >= bound[c["kind"]]))  # the most probable first
    none = F.array().cast(T.ArrayType(_SPAN))
    pick = F.aggregate(good, none, lambda done, c: F.when(F.forall(done, lambda d: free(d, c)), F.concat(done, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))).otherwise(done))
    return scored.withColumn("extra", pick).withColumn("spans", F.concat("base", "extra")).drop("proposed", "margin")


def _trees(model: GBTClassificationModel) -> tuple[list, list[float]]:
    """The trees as nested tuples: (feature, threshold, left, right), or a leaf's number."""

    def node(n):
        if n.subtreeDepth() == 0:
            return float(n.prediction())
        s = n.split()
        return (s.featureIndex(), float(s.threshold()), node(n.leftChild()), node(n.rightChild()))

    return [node(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights)


def _walk(tree, f) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
    return tree


def redact(text: str, spans: list) -> str:
    """text with [KIND] in place of each span; of overlapping spans the first counts."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
            done = s["end"]
    return "".join(out) + text[done:]


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    return found.select(
        "doc_id",
        *[F.size(F.array_remove(F.transform("base", lambda s: F.when(s["kind"] == k, 1).otherwise(0)), 0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size("extra").cast("long").alias("n_extra"),
        F.size(F.filter("extra", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )
