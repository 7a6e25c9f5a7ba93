"""Credentials embedded in source code and configuration: find them, and redact them in place.

``keypaths`` reads a text into leaves: values with the path of the keys that enclose them and their offsets. A leaf is a
credential if its own key is sensitive and its value has the shape of a literal, or if an enclosing key is sensitive and the
value looks random. Values that no configuration holds come from rules of their own: connection URLs, issued tokens by their
shape, headers, command options and prose. Redaction splices a mask over exactly those bytes and keeps everything else.

Lines of one file continue each other. A line that leaves a sensitive scope open (section, mapping, bracket, element) gives
it to the consecutive lines after it; a gap in the line numbers closes all scopes, because what stands there is unknown. Files
with such lines are read again in blocks of lines, each block with the scopes that the block before it left open, in as many
rounds as the longest scope has blocks. Private keys that span several lines are found from their BEGIN and END lines alone;
the lines between are fetched by a range join on blocks of lines of the file.

Defined results: NULL or empty text has no credential and is redacted to itself; a NULL file or line number takes no part
in a spanning key or scope; repeated lines are reported each; the text is processed whole; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from copy import deepcopy
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.arrow import text_stage
from skerry.llm.keypaths import NAME, Leaf, Scopes, byte_offsets, read_text
from skerry.operators.score import bind
from skerry.runtime import broadcast_if_small, cut, table

MASK = "***"
#: Lines of a block in the join of lines to spanning keys, and in the reading of files with open scopes.
BLOCK_LINES = 1000

# Words of a key name that make it sensitive, alone or joined (fixed values).
SENSITIVE_WORDS = set("password passwd pwd pw pass passe passphrase passcode secret token credential credentials contraseña contrasena kennwort passwort senha clave parola пароль 密码 パスワード 비밀번호 apikey authtoken accesstoken mdp motdepasse psk".split())
SENSITIVE_KEYS = set("api access account signing secret private auth encryption master storage shared client service".split())  # followed by: key
SENSITIVE_TAILS = ("password", "passwd", "pwd", "pass", "secret", "token", "apikey", "passphrase", "authtoken", "kennwort", "passwort", "contraseña")
# Words of a key name that say the value describes or refers to a credential (fixed values).
HARMLESS_WORDS = set("hash hint label title help file path type id public url uri name count length len max min page ttl expiry expires policy field prompt message text placeholder caption digest fingerprint checksum dir folder limit size form reset strength regex pattern salt env var ref tokens passwords".split())
# Key names that say nothing of their value, so that the key above them counts (fixed values).
GENERIC_KEYS = set("value val data default current content text string plain raw [] item".split())
# Ends of key names under which every value grants access (fixed values).
COLLECTIONS = ("passwords", "secrets", "tokens", "credentials", "creds", "apikeys", "api_keys", "passphrases")
# Words of keys that stand beside a credential under such a name (fixed values).
BESIDE = set("user username login email mail host port server domain database db driver scheme scopes scope region algorithm alg version enabled role owner contact created updated issued comment note description kind mode provider issuer audience endpoint method class style".split())
# Whole values that stand for a credential without being one (fixed values).
PLACEHOLDERS = set("todo tbd none null nil true false changeme change_me change-me replace_me replaceme placeholder dummy redacted [redacted] secret password token example sample test xxx n/a unset undefined empty hidden masked removed fixme".split())
PLACEHOLDER = re.compile(
    r"""(?ix)^(?: [*x.•·_\-#?]{3,} | .*\*{3,}.* | .*x{8,}.* | .*\.\.\. | <.*> | \[.*\] | \{\{.*\}\} | .*\$\{.*\}.* | \$\(.*\) | \$[a-z_]\w* | %[a-z_]+% | @@.*@@ | \#\{.*\} | __\w+__
    | (?:your|my|insert|enter|replace|example|change|put|add|use|set|dummy|fake|sample)[-_ ].* | .*[-_](?:here|placeholder|example) | (?:vault|file|env|secret|ssm|arn|keyring|op|kms|sm|aws|gcp|azure):.* | /[\w.\-]+(?:/[\w.\-]+)+
    | (?:os|process|env|config|settings|secrets|vars|system)\.[\w.\[\]()'"]+ | ![a-z]+\ .* )$"""
)
HASHED = re.compile(r"(?i)^(?:\$(?:2[abxy]?|argon2\w*|[156]|apr1|scrypt|pbkdf2[\w-]*|y|7)\$|\{(?:s?sha\d*|s?md5|crypt|bcrypt|pbkdf2[\w-]*)\}|pbkdf2|scrypt:|bcrypt:|argon2|(?:sha\d+|md5)[:\-])")
CAPTION = re.compile(r"(?i)\b(?:your|the|must|enter|show|paste|forgot|please|from|have|signs|mail|choose|type|repeat|and|of|is|a|an|to|for|in)\b")

# Issued tokens that grant access wherever they stand: fixed prefix and shape (fixed values).
ISSUED = re.compile(
    r"(?<![\w/+-])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|glpat-[\w-]{15,}|xox[abeoprs]-[\w-]{10,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{16,}|do[opr]_v1_[0-9a-f]{40,}|hf_[A-Za-z0-9]{20,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{20,}|[a-z]{2,5}_(?=[A-Za-z]*\d)(?=[a-z0-9]*[A-Z])[A-Za-z0-9]{20,}(?![\w.])|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,}|sq0[a-z]{3}-[\w-]{20,}|shp(?:at|ss|ca|pa)_[0-9a-f]{32}|AGE-SECRET-KEY-1[0-9A-Z]{40,})"
)
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", re.S)
URL = re.compile(r"[A-Za-z][\w+.-]*://([^\s:/@\"'`<>|]*):([^\s\"'`<>|]+?)@(?=\[?[\w.-]+\]?(?::\d+)?(?:[/?#\s\"'`<>,;)|\\]|$))")
SCHEME = re.compile(r"(?i)^(?:bearer|basic|token|apikey|api-key|digest|negotiate|key)\s+")
#: Words that name a value in running text, with the value in quotes.
SPOKEN = re.compile(rf"(?P<dash>--?)?(?P<key>{NAME})(?:(?<=\w)\s+(?P<q>[\"'`])|\s+(?:is|was|to)\s+(?P<said>[\"'`]))(?P<v>.*?)(?<!\\)(?:(?P=q)|(?P=said))")
WORDED = re.compile(
    rf"(?:\b(?:setenv|old|--?)\s*(?P<key>{NAME})(?:\s+was\s+|\s+|=)(?P<v>[^\s\"'`]+?)(?=,?\s|,?$)"
    r"|\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<netrc>\S+)|\bsshpass\s+-p\s*(?P<ssh>[^\s\"'`]+)|\blogin\b.*?\s(?:-p|--password)[\s=]+(?P<docker>[^\s\"'`]+)"
    r"|\b(?:pass\w*|pwd?|token|secret|key|login|credentials?)\s+(?:for|of|to|on)\s+[^\"'`=:]{1,40}?\s+(?:is|was)\s+(?P<prose>[^\s\"'`]+)|\blogin\(\s*[\"'][^\"']*[\"'],\s*[\"'](?P<pair>[^\"']+)[\"']|(?i:\bpassword|\bidentified\s+by)\s+'(?P<sql>[^']+)'|\bmysql\w*\s.*?\s-p(?P<mysql>[^\s\"'`]+)"
    r"|\blogin:\s*\S+\s+/\s+(?P<login>\S+)|(?:^|\s)-u\s+[\"']?[\w.-]+:(?P<curl>[^\s\"'`]+)|(?i:\bauthorization)[\"']?\s*[:=,]\s*[\"']?(?P<auth>(?:[A-Za-z]+\s+)?[^\s\"'`]+))"
)
WORD = re.compile(r"[A-ZÀ-Þ]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿ]+|[^\W\d_A-Za-zÀ-ÿ]+")
NO_SECRET = re.compile(r"^(?:[\w+.-]+://|[~./\\]|\d[\d.,:/T+-]*Z?$|v?\d+(?:\.\d+)+|[\w.+-]+@[\w-]+\.[\w.]+$|[\w-]+(?:\.[\w-]+)+$|[A-Za-z]+(?:[-_ ][A-Za-z]+)*$|[^\w]+$)")
CODE = re.compile(r"^[A-Za-z_][\w.]*(?:[(\[{].*|\)?[:,;)\]}]*)$")
#: What a text must hold in lower case for any rule to find something; texts without any of it never reach Python. The words
#: follow from the sensitive names, the rest are the fixed parts of the rules for commands, headers and issued tokens.
_STEMS = ("pass", "pw", "secret", "token", "cred", "key")
FRAGMENTS = [
    *_STEMS, *sorted(w for w in SENSITIVE_WORDS.union(SENSITIVE_TAILS) if not any(x in w for x in _STEMS)),
    "auth", "login", "identified", "mysql", "-u", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "npm_", "pypi-", "dop_v1_", "dor_v1_", "hf_", "k_live_", "k_test_",
    "aiza", "sg.", "akia", "asia", "eyj", "sq0", "shp",
]


def hinted(text: Column) -> Column:
    """True for every text that a rule can find something in, and for some others; plain searches in one lower-case copy."""

    def holds(low: Column) -> Column:
        fragment = reduce(Column.__or__, [F.contains(low, F.lit(f)) for f in FRAGMENTS])
        return fragment | (F.contains(low, F.lit("://")) & F.contains(low, F.lit("@"))) | (F.contains(low, F.lit("_")) & low.rlike(r"(?<![a-z0-9_])[a-z]{2,5}_[a-z0-9]{20}"))

    return bind(F.lower(text), holds)


BEGIN = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY"
END = r"-----END [A-Z0-9 ]*PRIVATE KEY"


def sensitive(key: str) -> bool:
    """True if a key name says that its value grants access."""
    words = [w.lower() for w in WORD.findall(key)]
    if not words or words[-1] in HARMLESS_WORDS or HARMLESS_WORDS.intersection(words[-2:]) or "public" in words:
        return False
    if words[-1] in SENSITIVE_WORDS or any(a in SENSITIVE_KEYS and b == "key" for a, b in zip(words, words[1:])):
        return True
    if words[-1].endswith("key") and words[-1][:-3] in SENSITIVE_KEYS:
        return True
    return words[-1].endswith(SENSITIVE_TAILS) and words[-1] not in ("compass", "bypass", "trespass", "surpass", "keypass")


def literal(value: str) -> bool:
    """True if a value has the shape of a literal credential: no placeholder, reference, mask, hash or caption."""
    if len(value) < 3 or value.startswith("-----") or value.lower() in PLACEHOLDERS or PLACEHOLDER.match(value) or HASHED.match(value):
        return False
    return not (" " in value and CAPTION.search(value))


def standing(path: tuple[str, ...]) -> str:
    """What a key path says of its value: ``own`` if the key itself is sensitive, ``within`` if an enclosing key is, else nothing."""
    keys = [k for k in path if k.lower() not in GENERIC_KEYS]
    if not keys:
        return ""
    if sensitive(keys[-1]):
        return "own"
    words = [w.lower() for w in WORD.findall(path[-1])]
    if HARMLESS_WORDS.intersection(words[-2:]) or BESIDE.intersection(words):
        return ""
    return "within" if any(sensitive(k) or k.lower().endswith(COLLECTIONS) for k in keys[:-1]) or keys[-1].lower().endswith(COLLECTIONS) and path[-1] != keys[-1] else ""


def random_looking(value: str) -> bool:
    """True if a value under a sensitive key is shaped like a credential by itself: one word of several kinds of characters."""
    kinds = sum(bool(re.search(k, value)) for k in ("[a-zà-ÿ]", "[A-ZÀ-Þ]", r"\d", r"[^\w\s]"))
    return len(value) >= 8 and kinds >= 2 and not re.search(r"\s", value) and not NO_SECRET.match(value)


def _accepts(text: str, leaf: Leaf) -> tuple[int, int] | None:
    """The span of the credential of a leaf, if it holds one."""
    a, b = leaf.start, leaf.end
    value = text[a:b]
    if leaf.path and leaf.path[-1].lower() in ("authorization", "auth"):
        s = SCHEME.match(value)
        if leaf.form == "plain" or not s and leaf.path[-1].lower() == "authorization":
            return None
        a += s.end() if s else 0
        return (a, b) if literal(text[a:b]) else None
    how = standing(leaf.path)
    if not how:
        return None
    if leaf.form == "plain":
        value = value.rstrip(",)}\\")
        b = a + len(value)
        before = text[:a].rstrip()[: -len(leaf.sep.strip())].rstrip()
        before = before[: len(before) - len(leaf.path[-1])].split("\n")[-1]
        prose = before.strip(" \t#/-;*'\"{") and "=" not in leaf.sep and leaf.sep != ":"
        tight = leaf.sep in "=:" and len(value) > 5 and not value.islower()
        if (not tight and CODE.match(value) and not re.search(r"\d", value)) or "(" in value or prose and not re.search(r"\d|[^\w]", value):
            return None
    s = SCHEME.match(value)
    if s and leaf.form == "quoted":
        a, value = a + s.end(), value[s.end() :]
    if leaf.form in ("quoted", "item") and leaf.sep == "(" and not re.search(r"\d", value) and sensitive(value):
        return None
    if not literal(value) or how == "within" and not random_looking(value):
        return None
    return a, b


def find_secrets(text: str, leaves: list[Leaf] | None = None) -> list[tuple[int, int]]:
    """Character spans of the credentials of one text, in order and without overlap.

    ``leaves`` are given where the lines before the text are known.
    """
    found: list[tuple[int, int]] = []

    def take(a: int, b: int) -> None:
        if a < b and all(b <= x or a >= y for x, y in found):
            found.append((a, b))

    for m in PEM.finditer(text):
        take(*m.span())
    for m in URL.finditer(text):
        if literal(m[2]):
            take(*m.span(2))
    blocked = [m.span() for m in URL.finditer(text)]

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in blocked)

    leaves = read_text(text) if leaves is None else leaves
    # A value whose own key is sensitive is judged whole, so what stands inside it is no value under that key.
    whole = [(x.start, x.end) for x in leaves if x.form == "quoted" and standing(x.path) == "own"]
    leaves = [x for x in leaves if standing(x.path) != "within" or not any(a <= x.start and x.end <= b for a, b in whole)]
    for leaf in sorted(leaves, key=lambda x: (x.form == "plain", x.start)):
        span = _accepts(text, leaf) if leaf.form != "plain" else None
        if span and free(*span):
            take(*span)
    for m in SPOKEN.finditer(text):
        if sensitive(m["key"]) and free(*m.span("v")) and literal(m["v"]) and (m["said"] or m["q"] == "`" or m["dash"]):
            take(*m.span("v"))
    for m in WORDED.finditer(text):
        if m["key"] is not None:
            if sensitive(m["key"]) and literal(m["v"]) and free(*m.span("v")) and not (m["v"].islower() and m["v"].isalpha()):
                take(*m.span("v"))
            continue
        group = next(g for g in ("netrc", "ssh", "docker", "prose", "pair", "sql", "mysql", "login", "curl", "auth") if m[g] is not None)
        a, b = m.span(group)
        if group == "auth":
            s = SCHEME.match(m[group])
            if not s:
                continue
            a += s.end()
        if literal(text[a:b]) and not (group == "prose" and text[a:b].isalpha() and text[a:b].islower()):
            take(a, b)
    for leaf in leaves:
        span = _accepts(text, leaf) if leaf.form == "plain" else None
        if span and free(*span):
            take(*span)
    for m in ISSUED.finditer(text):
        if literal(m[0]) and not re.search(r"(.)\1{7}", m[0]):
            take(*m.span())
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each span masked and all else kept."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


FOUND = "key bigint, secrets array<string>, starts array<int>, lengths array<int>, redacted string"


def _found(text: str, spans: list[tuple[int, int]]) -> tuple:
    """(secrets, starts, lengths, redacted) of a text; offsets count bytes."""
    at = byte_offsets(text, [x for span in spans for x in span])
    return [text[a:b] for a, b in spans], at[::2], [y - x for x, y in zip(at[::2], at[1::2])], redact(text, spans)


def opens_scope(scopes: Scopes) -> bool:
    """True if values after this point stand under a sensitive key."""
    return any(sensitive(k) or k.lower().endswith(COLLECTIONS) for k in scopes.path())


def _scan(batch: pa.RecordBatch) -> list[list]:
    """Findings by row, and a row for each text that leaves a sensitive scope open."""
    out: list[list] = [[], [], [], [], [], [], []]
    for key, file, line, text in zip(*(c.to_pylist() for c in batch.columns)):
        scopes = Scopes()
        spans = find_secrets(text, read_text(text, scopes))
        opener = opens_scope(scopes) and file is not None and line is not None
        if spans or opener:
            for column, value in zip(out, (key, *(_found(text, spans) if spans else (None, None, None, None)), file if opener else None, line if opener else None)):
                column.append(value)
    return out


CONTINUED = f"{FOUND}, file string, line int, block bigint, context string"
_CONTINUED = pa.schema([("key", pa.int64()), ("secrets", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("redacted", pa.string()), ("file", pa.string()), ("line", pa.int32()), ("block", pa.int64()), ("context", pa.string())])


def _continue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (key, file, line, text, block, context) in the order of file, block and line.

    Gives findings that stand under a scope of an earlier line, and per block the scopes to hand to the next one.
    """
    at, before, after, line_before, out = None, Scopes(), Scopes(), None, []

    def leave() -> None:
        if at is not None and opens_scope(after):
            out.append((None, None, None, None, None, at[0], line_before, at[1] + 1, json.dumps([line_before, after.dump()])))

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _CONTINUED)], schema=_CONTINUED)
        out.clear()
        return made

    for b in batches:
        for key, file, line, text, block, context in zip(*(c.to_pylist() for c in b.columns)):
            if at != (file, block):
                leave()
                at, line_before, after = (file, block), None, Scopes()
                if context is not None:
                    line_before, dumped = json.loads(context)
                    after = Scopes.load(dumped)
            if line != line_before:  # the first of equal lines moves the scopes on
                before = after if line_before is not None and line == line_before + 1 else Scopes()
                line_before, first = line, True
            scopes = deepcopy(before)
            leaves = read_text(text, scopes)
            if opens_scope(before):
                spans = find_secrets(text, leaves)
                if spans:
                    out.append((key, *_found(text, spans), file, line, None, None))
            if first:
                after, first = scopes, False
        if len(out) >= 1000:
            yield batch()
    leave()
    if out:
        yield batch()


def continued(rows: DataFrame, openers: DataFrame) -> DataFrame | None:
    """Findings (with file and line) below scopes that earlier lines of ``openers``' files leave open; None if there are none."""
    files = cut(openers.select("file").distinct())
    if files.isEmpty():
        return None
    blocks = rows.where("line is not null and text is not null").withColumn("block", block_of(F.col("line")))
    todo = blocks.join(broadcast_if_small(files, 200), "file", "left_semi").withColumn("context", F.lit(None).cast("string"))
    results: list[DataFrame] = []
    while True:
        ordered = todo.select("key", "file", "line", "text", "block", "context").repartition("file", "block").sortWithinPartitions("file", "block", "line", "key")
        got = cut(ordered.mapInArrow(_continue, CONTINUED))
        results.append(got.where("key is not null").drop("block", "context"))
        passed = got.where("key is null").select("file", "block", "context")
        if passed.isEmpty():
            break
        todo = blocks.join(broadcast_if_small(passed, 400), ["file", "block"])
    found = results[0]
    for r in results[1:]:  # a block that is read again with scopes from before replaces what it gave without them
        found = found.join(r.select("key").distinct(), "key", "left_anti").unionByName(r)
    return found


def spanning_key_places(rows: DataFrame) -> DataFrame:
    """(key_file, block, from, to): the lines strictly between the BEGIN and END lines of a private key, by blocks of lines.

    Only mark lines are ordered within a file, so a file of any length is never gathered in one task. A key of any length has
    one row for each block that it touches.
    """
    begin, end = F.col("text").rlike(BEGIN), F.col("text").rlike(END)
    marks = rows.where((begin | end) & ~(begin & end) & F.col("file").isNotNull() & F.col("line").isNotNull()).select("file", "line", begin.alias("begin")).distinct()
    w = Window.partitionBy("file").orderBy("line", F.col("begin").desc())
    open_ = marks.select("file", "line", "begin", F.lead("line").over(w).alias("to"), F.lead("begin").over(w).alias("next"))
    inner = open_.where(F.col("begin") & ~F.col("next") & (F.col("to") - F.col("line") >= 2))
    first, last = block_of(F.col("line") + 1), block_of(F.col("to") - 1)
    return inner.select(F.col("file").alias("key_file"), F.explode(F.sequence(first, last)).alias("block"), F.col("line").alias("from"), "to")


def block_of(line: Column) -> Column:
    return F.floor(line / BLOCK_LINES).cast("bigint")


def scan_credentials(df: DataFrame, key: str, group: str, line: str, text: str) -> DataFrame:
    """(key, secrets, starts, lengths, redacted): one row per row of ``df`` with a credential; offsets count bytes.

    Lines inside a spanning key are that key's; all other lines that carry a hint are parsed.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(group).alias("file"), F.col(line).cast("int").alias("line"), F.col(text).alias("text"))
    places = broadcast_if_small(cut(spanning_key_places(rows)), 200)
    inside = (F.col("file") == F.col("key_file")) & (block_of(F.col("line")) == F.col("block")) & (F.col("line") > F.col("from")) & (F.col("line") < F.col("to"))
    hints = rows.where(hinted(F.col("text"))).join(places, inside, "left_anti").select("key", "file", "line", "text")
    fields = [*_CONTINUED][:5]
    stage = text_stage([(f.name, f.type) for f in fields] + [("file", pa.string()), ("line", pa.int32())], _scan)
    scanned = cut(hints.mapInArrow(stage, f"{FOUND}, file string, line int"))
    columns = [f.name for f in fields]
    single = scanned.where("secrets is not null").select(*columns)
    below = continued(rows, scanned.where("file is not null"))
    if below is not None:
        below = below.join(places, inside, "left_anti").select(*columns)
        single = single.join(below.select("key").distinct(), "key", "left_anti").unionByName(below)
    body = F.regexp_replace(F.regexp_replace("text", r"^\s*(?:(?:#|//|--|\*|;|>|%)+\s*)?", ""), r"\s+$", "")
    lines = rows.join(places, inside, "left_semi").select("key", "text", body.alias("body")).where("body <> ''")
    head = F.substring("text", F.lit(1), F.instr("text", F.col("body")) - 1)
    inner = lines.select(
        "key", F.array("body").alias("secrets"), F.array(F.octet_length(head).cast("int")).alias("starts"), F.array(F.octet_length("body").cast("int")).alias("lengths"),
        F.concat(head, F.lit(MASK), F.expr("substring(text, instr(text, body) + length(body))")).alias("redacted"),
    )
    return single.unionByName(inner)


def p3_found(spark, sf_dir):
    found = scan_credentials(table(spark, sf_dir, "content_hits"), "hit_id", "path", "line", "text")
    return found.select(F.col("key").alias("hit_id"), F.explode(F.array_distinct("secrets")).alias("secret"))


def p3_redacted(spark, sf_dir):
    found = scan_credentials(table(spark, sf_dir, "content_hits"), "hit_id", "path", "line", "text")
    return found.select(F.col("key").alias("hit_id"), F.size("secrets").alias("n_secrets"), "starts", "lengths", "redacted")


def p3_roundtrip(spark, sf_dir):
    """Every hit with its text, where the credentials are spliced back into the redacted text at their byte offsets."""
    hits = table(spark, sf_dir, "content_hits").select("hit_id", "text")
    found = scan_credentials(table(spark, sf_dir, "content_hits"), "hit_id", "path", "line", "text").select(F.col("key").alias("hit_id"), "secrets", "starts", "redacted")
    raw = F.aggregate(
        F.arrays_zip("starts", "secrets"), F.encode("redacted", "utf-8"),
        lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["starts"]), F.encode(x["secrets"], "utf-8"), F.substring(acc, x["starts"] + len(MASK) + 1, F.octet_length(acc))),
    )
    return hits.join(found.select("hit_id", F.decode(raw, "utf-8").alias("again")), "hit_id", "left").select("hit_id", F.coalesce("again", "text").alias("text"))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted, "p3_roundtrip": p3_roundtrip}
ORACLE = {"p3_roundtrip": "select hit_id, text from content_hits"}
