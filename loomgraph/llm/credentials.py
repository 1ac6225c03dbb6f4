"""Problem 3: credentials in source and configuration files.

Every literal with the look of a value (quoted, assigned, flagged, in an address, a header or a comment) is indexed
over the whole corpus with its owner, its surroundings, its form and what stands beside it. Values that owners share
independently of each other are placeholders and fall out; copies of one file count once. A rare value is confirmed
by its form alone, by its randomness if nothing beside it says otherwise, or by its structure together with what
stands beside it: a credential's name, a user beside it in a record or a call, a flag, a comment. Names are known
ones and those that the corpus keeps beside confirmed values. All files are then scanned again for the confirmed
values by the hashes of their heads, so that a secret is found where nothing beside it tells. Redaction changes
the secret's own characters only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut

#: A value is a placeholder if at least this share of all owners hold it independently, and at least MIN_OWNERS do;
#: a random value (nobody makes one up twice) needs RANDOM_TIMES as many.
SHARED, MIN_OWNERS, RANDOM_TIMES = 0.005, 6, 4
#: A name is a credential's if so many owners have it beside confirmed values, and so large a share of its structured values is confirmed.
NAME_OWNERS, NAME_SHARE = 2, 0.6
SHORT = 10  # a shorter value recurs only between quotes, blanks or marks of assignment
#: Texts are matched by the values' first ANCHOR characters. The bitmap of their hashes has 2^ANCHOR_BITS bits for a block of values.
BLOCK_VALUES, ANCHOR, ANCHOR_BITS = 500_000, 6, 24
MASK = "REDACTED"

#: Forms that are credentials wherever they stand (fixed patterns of public key formats).
STRUCTURED = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?P<cloud>(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16})(?![A-Za-z0-9])"
    r"|(?P<forge>gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,})"
    r"|(?P<chat>xox[abposr]-[A-Za-z0-9-]{10,})"
    r"|(?P<pay>(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,})"
    r"|(?P<map>AIza[\w-]{30,})|(?P<mail>SG\.[\w-]{16,}\.[\w-]{16,})"
    r"|(?P<jwt>eyJ[\w-]{8,}\.eyJ[\w-]{8,}(?:\.[\w-]*)?)"
    r"|(?P<hook>https://hooks\.[\w.-]+/(?:services|workflows)/[A-Z0-9]+/[A-Z0-9]+/[A-Za-z0-9]{12,})"
    r"|(?P<basic>(?<=[Bb]asic )[A-Za-z0-9+/]{10,}={0,2})|(?P<bearer>(?<=[Bb]earer )[\w.~+/-]{12,}=*)"
    r")"
)
#: A header that authorises, whatever its scheme.
HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization[\"']?\s*[:=,]\s*[\"']?\s*(?P<scheme>[A-Za-z][\w-]*)\s+(?:\w+=[\"']?)?(?P<value>[\w.~+/-]{8,}=*)")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_BODY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END |\Z|(?=[\"'`]))", re.S)
ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]*://(?P<user>[^\s:/@\"'<>]*):(?P<value>[^\s/@\"'<>]+)@(?=[\w\[])")
QUERY = re.compile(r"[?&](?P<name>[\w-]+)=(?P<value>[^\s&\"'<>#]{6,})")
#: name, then = or : (with a type in between), then a quoted or bare value.
ASSIGNED = re.compile(
    r"(?<![\w.$-])(?P<nq>[\"']?)(?P<name>[A-Za-z_$][\w.$-]*)(?P=nq)(?:\s*:\s*[A-Za-z_][\w<>\[\]. |]*?(?=\s*=))?\s*(?::=|=>|==?|:(?!:))\s*(?:[urbf]{0,2})"
    r"(?:\"(?P<d>(?:[^\"\\\n]|\\.)*)(?:\"|$)|'(?P<s>(?:[^'\\\n]|\\.)*)(?:'|$)|`(?P<t>[^`\n]*)(?:`|$)|(?P<b>[^\s\"'`,;(){}\[\]#=]+(?:[#=]+[^\s\"'`,;(){}\[\]#=]*)*)(?=\s*(?:[,;})\"'`&]|\s#|$)))"
)
QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
JOINED = re.compile(r"[\"']\s*[+.]?\s*[\"']((?:[^\"'\\\n]|\\.)*)(?=[\"'])")
FLAG = re.compile(r"(?<![\w-])--?(?P<name>[A-Za-z][\w-]*)(?:=|\s+)(?P<q>[\"']?)(?P<value>[^\s\"'$(){}<>|;&-][^\s\"']{5,})(?P=q)(?![\w])")
#: user:secret after a command's -u, and a secret joined to -p.
USER_FLAG = re.compile(r"(?<![\w-])-[A-Za-z]*u\s*(?P<q>[\"']?)[\w.@-]+:(?P<value>[^\s\"']{6,})(?P=q)|(?<![\w-])-p[\"']?(?P<v2>[^\s\"'=-][^\s\"']{5,})")
#: A variable set for one command; a word that announces a bare value; the text of an element with that name.
PREFIXED = re.compile(r"(?<![\w.$-])(?P<name>[A-Za-z_]\w*)=(?P<value>[^\s\"'`$();|&<>]{6,})(?=\s)")
ANNOUNCED = re.compile(r"(?i)(?<![\w-])(?P<name>[\w-]*(?:passw(?:or)?d|passphrase|secret|token)|identified by)\s+[\"']?(?P<value>[^\s\"'`=:(){}<>,;$]{6,})")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z][\w.:-]*)(?:\s[^<>]*)?>\s*(?P<value>[^<>\s]{6,})\s*</")
COMMENT = re.compile(r"(?:^|\s)(?:#|//|/\*|\*|;|--|<!--|rem\s)\s*(?P<text>\S.*)$", re.I)
_TAIL = re.compile(r"(?:^|[\s:=/|,(])[\"'`]?(?P<value>[^\s\"'`,|()]{6,}?)[.,;)]?[\"'`]?\s*(?:\*/|-->)?\s*$")
#: What can hold a value at all: letters beside digits, an address with a colon, a key's head or a credential's name.
_WORTH = re.compile(r"[A-Za-z][^\s\"'`A-Za-z\d]*\d|\d[^\s\"'`A-Za-z\d]*[A-Za-z]|\w[#$%^&!@*?~]\w|[a-z]://[^\s/]*:|BEGIN [A-Z ]*PRIVATE|(?:[Pp]ass|PASS|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Pp]hrase|PHRASE|[Cc]red|CRED|\b[Pp](?:in|IN)\b)[\w-]*[\"']?[ \t]*[:=]")
#: Parts of a name that make it a credential's (fixed values), with the parts that take that back.
STRONG = frozenset("password passwd passphrase pwd pass pw secret token apikey credential credentials creds passcode".split())
PAIRS = frozenset(("api_key", "access_key", "secret_key", "private_key", "auth_key", "maps_key", "client_secret", "auth_token", "signing_key", "encryption_key", "account_key", "storage_key", "master_key", "service_key", "license_key", "pin_phrase", "pass_phrase"))
NOT_NAMES = frozenset("public column field label header name url uri path file env title prefix suffix type len length count counter max min size ttl expiry regex pattern placeholder hint policy limit format index page list kind".split())
#: Parts of a name whose random values are no secrets: checksums, ids, versions, pictures (fixed values).
INNOCENT = frozenset("hash digest checksum sha sha1 sha256 sha512 md5 crc etag integrity fingerprint commit revision rev ref id ids uuid guid version thumb image img icon picture photo font svg png jpg gif data blob base64 class classname style css color colour href src link address module resolved".split())
USERS = frozenset("who login user username user_name account principal owner".split())
_PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>?|\$\{.*|\$\(?\w.*|%\w+%|\{\{.*|\[.*\]|x{3,}|\*+|\.+|-+|null|none|nil|true|false|undefined|changeme.*|change[-_]?me.*|replace[-_]?me.*|your[-_ ].*|.*your[-_].*here.*|(?:example|sample|dummy)(?:[-_ ]?(?:password|secret|key|token|value|credential)s?)?|test|todo|placeholder|redacted.*|secret|password|process\.env.*|os\.environ.*|os\.getenv.*|getenv.*|system\.getenv.*|env\..*|config\..*|settings\..*|self\..*|this\..*|params?\..*|args?\..*|vault:.*|arn:.*|file:.*|env:.*)$"
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_CODE = re.compile(r"^(?:[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*[(\[]|[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)+(?<!\d\d)$)")
_OTHER = re.compile(r"^(?:ssh-|data:|sha\d+-|[a-z][\w+.-]*://|[./~]|[\d.:,/xX%+-]+$|\d{4}-\d\d-\d\d|v?\d+\.\d+|[\w.+-]+/[\w.+-]+$|#[0-9a-fA-F]{3,8}$|\w+@[\w.-]+$|[\w.-]+\.[a-z]{1,4}\d?$)")
_WORD_RUN = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}")
_ODD_RUN = re.compile(r"(?i)[^aeiouy\W\d_]{5,}")
_DOC = re.compile(r"EXAMPLE|0123456789ABCDEF|ABCDEFGHIJ|1234567890")


def name_parts(name: str) -> list[str]:
    return [p for p in re.split(r"[_.$-]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if p]


@lru_cache(100_000)
def name_says(name: str) -> int:
    """2 if a name is a credential's, 1 if it may be, 0 if it says nothing, -2 if it tells of something else."""
    parts = name_parts(name)
    while parts and parts[-1].isdigit():
        parts.pop()
    if parts and (parts[-1] in NOT_NAMES or "public" in parts):
        return -2
    if "apikey" in parts or any(p in STRONG for p in parts) or any("_".join(parts[i : i + 2]) in PAIRS for i in range(len(parts))):
        return 2
    if parts and (parts[-1] in ("key", "auth", "signature", "pin", "phrase", "salt") or "auth" in parts):
        return 1
    return -2 if any(p in INNOCENT for p in parts) else 0


@lru_cache(200_000)
def strength(v: str) -> int:
    """What a value's own form says: 3 random, 2 mixed like a password, 1 structured (letters with digits or marks), 0 words, -1 something else."""
    if len(v) < 6 or len(v) > 300 or _PLACEHOLDER.match(v) or _CODE.match(v) or _OTHER.match(v) or _UUID.match(v):
        return -1
    if re.search(r"[\s<>{}\\]", v):
        return 0
    digit, lower, upper = bool(re.search(r"\d", v)), bool(re.search(r"[a-z]", v)), bool(re.search(r"[A-Z]", v))
    mark = bool(re.search(r"[^\w./-]", v))
    if not (lower or upper):
        return -1
    if not digit and not mark:
        # letters only: both cases mixed within the words, as no name does
        return 1 if len(v) >= 16 and re.fullmatch(r"[A-Za-z]+", v) and lower and upper and _left(v) >= 0.5 else 0
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v):
        return 1  # a number in hexadecimals: checksums and ids look alike
    if _left(v) >= 0.5 and digit and ((len(v) >= 16 and (lower and upper or mark)) or (len(v) >= 20 and lower)):
        return 3
    if len(v) >= 8 and digit and upper and lower and (mark or re.search(r"[-_]", v) or _left(v) >= 0.5) and not re.search(r"[/()\[\]]", v):
        return 2
    return 1


def _left(v: str) -> float:
    """Share of the characters that belong to no word that could be spoken."""
    rest = _WORD_RUN.sub(lambda m: m.group() if _ODD_RUN.search(m.group()) or not re.search(r"(?i)[aeiouy]", m.group()) else "", v)
    return len(rest) / len(v)


class Literal:
    """A value on a line: where it stands, its form's strength and what stands beside it (context and name)."""

    __slots__ = ("context", "end", "name", "start", "strength", "sure", "value")

    def __init__(self, value: str, start: int, end: int, form: int, context: int, name: str = "", sure: bool = False):
        self.value, self.start, self.end, self.strength, self.context, self.name, self.sure = value, start, end, form, context, name, sure


def _spoken(v: str) -> bool:
    """A passphrase of several words with a digit or a mark in it, beside a credential's name."""
    return " " in v and bool(re.search(r"\d", v)) and 10 <= len(v) <= 100 and not re.search(r"[<>{}\\%=]", v)


def _forms(line: str, out: list[Literal]) -> None:
    for m in STRUCTURED.finditer(line):
        v = m.group()
        if not (m.lastgroup == "basic" and not re.search(r"[A-Z0-9=]", v)) and not (m.lastgroup == "bearer" and not re.search(r"\d", v)):
            out.append(Literal(v, m.start(), m.end(), 3, 2, sure=True))
    if "://" in line:
        out += [Literal(m["value"], m.start("value"), m.end("value"), 2, 2, sure=True) for m in ADDRESS.finditer(line) if not _PLACEHOLDER.match(m["value"])]
        for m in QUERY.finditer(line):
            says = 2 if m["name"].lower() in ("sig", "signature") else name_says(m["name"])
            out.append(Literal(m["value"], m.start("value"), m.end("value"), strength(m["value"]), says, m["name"].lower()))
    if "uthoriz" in line or "UTHORIZ" in line:
        out += [Literal(m["value"], m.start("value"), m.end("value"), strength(m["value"]), 2) for m in HEADER.finditer(line) if m["scheme"].lower() not in ("basic", "bearer")]


def literals(line: str, before: str = "") -> list[Literal]:
    """Every literal on a line that has the look of a value; `before`: the name that the previous line leaves open."""
    out: list[Literal] = []
    _forms(line, out)
    taken = [(x.start, x.end) for x in out]

    def add(v: str, a: int, b: int, context: int, name: str = "") -> None:
        if any(x < b and a < y for x, y in taken):
            return
        form = strength(v)
        if form < 0 and context >= 2 and re.fullmatch(r"\d{6,12}", v) and name_parts(name)[-1:] in (["pin"], ["passcode"], ["password"], ["pass"]):
            form = 1  # a number to type in
        if form == 0 and context >= 2 and _spoken(v):
            form = 1
        if form > 0:
            taken.append((a, b))
            out.append(Literal(v, a, b, form, context, name.lower()))

    named: dict[int, tuple[str, int]] = {}
    fields: list[tuple[str, str]] = []  # name and value of the string fields so far
    at = 0
    while m := ASSIGNED.search(line, at):
        at = m.end("name") + len(m["nq"])
        g = next(k for k in "dstb" if m[k] is not None)
        name, v, end = m["name"], m[g], m.end(g)
        if g in "ds":
            named[m.start(g)] = (name, end)
            while j := JOINED.match(line, end):
                v += j.group(1)
                end = j.end()
        context = name_says(name)
        if name_parts(name)[-1:] == ["pin"] and re.fullmatch(r"\d{4,12}", v):
            context = 2
        if context >= 0 and g != "b" and fields and context < 2:
            last, word = fields[-1]
            if re.fullmatch(r"[A-Za-z][\w.@-]{1,40}", word) and strength(word) <= 0 and (last in USERS or name_parts(last)[-1:] and name_parts(last)[-1] in USERS or strength(v) >= 2):
                context = max(context, 1)
        fields.append((name.lower(), v))
        if g != "b" or context > 0:
            add(v, m.start(g), end, context, name)
    if " -" in line:
        for m in FLAG.finditer(line):
            add(m["value"], m.start("value"), m.end("value"), name_says(m["name"]), m["name"])
        for m in USER_FLAG.finditer(line):
            g = "v2" if m["v2"] else "value"
            if g == "value" or (strength(m[g]) >= 1 and re.search(r"\d", m[g])):
                add(m[g], m.start(g), m.end(g), 2)
    if "=" in line:
        for m in PREFIXED.finditer(line):
            add(m["value"], m.start("value"), m.end("value"), min(name_says(m["name"]), 2) if name_says(m["name"]) > 0 else -1, m["name"])
    if "</" in line:
        for m in ELEMENT.finditer(line):
            add(m["value"], m.start("value"), m.end("value"), name_says(m["name"].replace(":", "_")), m["name"])
    for m in ANNOUNCED.finditer(line):
        if re.search(r"\d", m["value"]):
            add(m["value"], m.start("value"), m.end("value"), 1)
    m = COMMENT.search(line)
    if m:
        t = _TAIL.search(line, m.start("text"))
        if t and re.search(r"\d", t["value"]) and re.search(r"[A-Za-z]", t["value"]):
            said = name_parts(re.sub(r"[^\w]+", "_", line[m.start("text") : t.start("value")]))
            keys = any(p in STRONG or p in ("key", "login", "pin", "phrase") for p in said)
            add(t["value"], t.start("value"), t.end("value"), 1 if keys else -1 if strength(t["value"]) < 3 or any(p in INNOCENT for p in said) else 0)
    strings: list[tuple[int, int, str]] = []
    for m in QUOTED.finditer(line):
        k = m.lastindex or 1
        strings.append((m.start(k), m.end(k), m[k] or ""))
    for i, (a, b, v) in enumerate(strings):
        if a in named:
            continue
        if line[b + 1 : b + 3].lstrip().startswith((":", "=>")) or len(v) < 6:
            continue  # a key
        end, value = b, v
        while j := JOINED.match(line, end):
            value += j.group(1)
            end = j.end()
        context = 0
        # the third string of a call that opens something for a user at a host
        if i >= 2 and "(" in line[: strings[i - 2][0]] and line[strings[i - 2][1] + 1 : strings[i - 1][0] - 1].strip() == "," == line[strings[i - 1][1] + 1 : a - 1].strip():
            host, user = strings[i - 2][2], strings[i - 1][2]
            if re.search(r"[.:]|localhost", host) and re.fullmatch(r"[\w.@-]{2,60}", user):
                context = 2
        if not context:
            # what the call or the expression around it speaks of: set_password("..."), get("DB_PASSWORD", "..."), token or "..."
            spoken = [name_says(w) for w in re.findall(r"[A-Za-z_$][\w$-]*", line[max(0, a - 60) : a])[-4:]]
            context = 2 if spoken and spoken[-1] == 2 else 1 if 2 in spoken else min(spoken[-1:] + [0])
        if before and not line[:a].strip(" \t\"'`(+."):
            context = max(context, name_says(before))
        add(value, a, end, context, before if context and before else "")
    return out


_OPEN = re.compile(r"([A-Za-z_$][\w.$-]*)[\"']?\s*(?::\s*[A-Za-z_][\w<>. ]*)?\s*(?:=|:|=>|:=)\s*(?:\(|\\|\||>-?|\|-)?\s*$")


def scan(text: str) -> list[tuple]:
    """(line_no, value, start, end, sure, strength, context, name, surroundings) over a text; the first line is the path.

    A private key has an empty value and is sure. Of random strings that stand in rows, as data does, only those
    with a credential's name count as more than structured.
    """
    out: list[tuple] = []
    no, start = 1, 0
    first = at = text.find("\n") + 1
    while first and (hit := _WORTH.search(text, at)):
        # the line of the hit; lines without one hold nothing
        here = text.rfind("\n", 0, hit.start()) + 1
        no, start = no + text.count("\n", start, here), here
        end = text.find("\n", hit.start())
        end = len(text) if end < 0 else end
        at = end + 1
        flat = text[start:end].rstrip("\r")
        last = text.rfind("\n", 0, start - 1) + 1
        above = text[last : start - 1].rstrip("\r") if last >= first else ""
        # a value may stand alone on the line after its name
        m = _OPEN.search(above) if above.endswith(("=", ":", "(", "\\", "|", ">", "-")) else None
        found = literals(flat, m.group(1) if m else "")
        if found:
            below = text.find("\n", at)
            near = xxhash.xxh64_intdigest(text[max(last, first) : below if below >= 0 else len(text)]) >> 1
            out += [(no, x.value, start + x.start, start + x.end, x.sure, x.strength, x.context, x.name, near) for x in found]
        if "PRIVATE KEY" in flat:
            for m in PRIVATE.finditer(flat):
                body = PRIVATE_BODY.match(text, start + m.start())
                out.append((no, "", start + m.start(), body.end(1) if body else start + m.end(), True, 3, 2, "", 0))
    keys = [(x[2], x[3]) for x in out if not x[1]]
    # what stands inside a private key, or in a row of random strings of one length, is no value of its own
    rows: dict[int, int] = {}
    for x in out:
        if x[5] == 3 and not x[4] and x[6] <= 0:
            rows[len(x[1])] = rows.get(len(x[1]), 0) + 1
    return [x for x in out if not x[1] or (not any(a <= x[2] < b for a, b in keys) and (x[4] or x[6] > 0 or rows.get(len(x[1]), 0) < 3))]


_LITERAL = "ord bigint, owner string, line_no bigint, value string, begin int, finish int, sure boolean, strength int, context int, name string, near bigint"


def found_literals(examples: DataFrame) -> DataFrame:
    """The literal index: every literal of every text with its owner and surroundings. Null texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(o, t.partition("/")[0].lower(), *x) for o, t in zip(b["ord"], b["text"], strict=True) for x in scan(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LITERAL.split(", ")])

    return examples.select("ord", "text").where("text IS NOT NULL").mapInPandas(run, _LITERAL)


_SAID = "sure OR (strength >= 1 AND context >= 1 AND NOT (strength = 1 AND context = 1 AND lower(value) RLIKE '^[0-9a-f]+$')) OR (strength >= 2 AND context >= 0)"


def confirmed(index: DataFrame, owners: int) -> DataFrame:
    """(value) of the credentials in the index of a corpus of so many owners.

    Owners are counted over distinct surroundings, so copies of one file count once.
    """
    i = index.where("value <> ''").withColumn("said", F.expr(_SAID))
    # names that the corpus keeps beside confirmed values speak for structured values beside them
    tells = i.where("name <> '' AND context >= 0 AND strength >= 1").groupBy("name").agg(F.countDistinct(F.when(F.col("said"), F.col("owner"))).alias("n"), F.avg(F.col("said").cast("int")).alias("share"))
    tells = tells.where((F.col("n") >= NAME_OWNERS) & (F.col("share") >= NAME_SHARE)).select("name", F.lit(True).alias("tells"))
    i = i.join(tells, "name", "left").withColumn("said", F.col("said") | (F.coalesce("tells", F.lit(False)) & (F.col("context") >= 0) & (F.col("strength") >= 1)))
    apart = i.groupBy("value", "near").agg(F.min("owner").alias("owner"), F.max("said").alias("said"), F.max("sure").alias("sure"), F.max("strength").alias("strength"))
    per = apart.groupBy("value").agg(F.countDistinct("owner").alias("n"), F.max("said").alias("said"), F.max("sure").alias("sure"), F.max("strength").alias("strength"))
    most = max(MIN_OWNERS, SHARED * owners)
    shared = F.col("n") >= F.when(F.col("strength") >= 3, RANDOM_TIMES * most).otherwise(most)
    # documentation keys spell out that they are examples
    doc = F.upper("value").rlike(_DOC.pattern)
    return per.where(F.col("said") & (F.col("sure") | ~shared) & ~doc).select("value")


_BESIDE = " \t\r\n\"'`=:@/,;|()[]{}<>"


def _stands(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] is a value of its own there: no word goes on; a short one is between marks or blanks."""
    left, right = text[a - 1 : a], text[b : b + 1]
    if left.isalnum() or right.isalnum():
        return False
    return b - a >= SHORT or ((not left or left in _BESIDE) and (not right or right in _BESIDE))


_PLACE = "ord bigint, line_no bigint, begin int, finish int"


@lru_cache(1)
def _word() -> np.ndarray:
    """For every code point whether it goes on a word (str.isalnum)."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _heads(text: str, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, hashes of so many characters from there) for each of the sizes, at the places below the first line where no word goes on.

    A size below ANCHOR is a whole value's: only places where no word goes on behind it.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    first, word = text.find("\n"), _word()
    at = np.flatnonzero(~word[c[first:-1]]) + first + 1 if first >= 0 else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for i in range(ANCHOR):
        inside = at + i < len(c)
        at, h = at[inside], h[inside]
        with np.errstate(over="ignore"):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[at + i] + np.uint64(1)
        if i + 1 in sizes:
            ends = slice(None) if i + 1 == ANCHOR else ~word[c[np.minimum(at + i + 1, len(c) - 1)]] | (at + i + 1 == len(c))
            yield i + 1, at[ends], _mixed(h[ends])


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _key(value: str) -> tuple[int, int]:
    """(size, hash) of a value's head: of its first ANCHOR characters, or of all of a shorter one."""
    return next((k, int(h[0])) for k, _, h in _heads("\n" + value[:ANCHOR], (min(len(value), ANCHOR),)))


def rescan(examples: DataFrame, values: DataFrame, block: int = BLOCK_VALUES) -> DataFrame:
    """(ord, line_no, begin, finish) of every place of a confirmed value, in one pass over the texts, however many values.

    Places whose head may be a value's by a bitmap are joined with the values. The bitmap doubles with the blocks of
    values; it only saves rows of the join.
    """
    texts = examples.select("ord", "text").where("text IS NOT NULL")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(v, *_key(v)) for v in b["value"]], columns=["value", "size", "h"])

    keyed = cut(values.select("value").where("value <> ''").mapInPandas(keys, "value string, size int, h bigint"))
    n, longest = keyed.agg(F.count(F.lit(1)), F.max(F.length("value"))).first()
    mask = np.int64((1 << ANCHOR_BITS + max(0, -(-n // block) - 1).bit_length()) - 1)
    sizes = tuple(r.size for r in keyed.select(F.col("size")).distinct().collect())  # ANCHOR at most
    bits = np.zeros(int(mask) + 1, bool)
    bits[keyed.select(F.col("h").bitwiseAND(F.lit(int(mask))).alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    shared = examples.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = shared.value
        for b in batches:
            rows = []
            for o, t in zip(b["ord"], b["text"], strict=True) if sizes else ():
                for k, at, h in _heads(t, sizes):
                    slot = h & mask
                    may = np.flatnonzero(on[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                    rows += [(o, t.count("\n", 0, a) + 1, a, k, x, t[a - 1 : a + longest + 1]) for a, x in zip(at[may].tolist(), h[may].tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["ord", "line_no", "begin", "size", "h", "piece"])

    hits = texts.mapInPandas(places, "ord bigint, line_no bigint, begin int, size int, h bigint, piece string")
    same = hits.join(keyed, ["size", "h"]).where(F.expr("substring(piece, 2, length(value)) = value"))

    def stands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [_stands(p, 1, 1 + len(v)) for p, v in zip(b["piece"], b["value"], strict=True)]
            b = b[ok]
            yield pd.DataFrame({"ord": b["ord"], "line_no": b["line_no"], "begin": b["begin"], "finish": b["begin"] + b["value"].str.len().astype("int32") if len(b) else b["begin"]})

    return same.select("ord", "line_no", "begin", "piece", "value").mapInPandas(stands, _PLACE)


def spans(examples: DataFrame) -> DataFrame:
    """(ord, line_no, begin, finish) of every credential: confirmed where first seen, and wherever it recurs.

    A repeated row has its own spans. Ties and overlaps are kept; redaction merges them.
    """
    index = cut(found_literals(examples))
    owners = examples.where("text IS NOT NULL").select(F.lower(F.substring_index("text", "/", 1)).alias("o")).distinct().count()
    values = cut(confirmed(index, owners))
    keys = index.where("value = ''").select("ord", "line_no", "begin", "finish")
    direct = index.join(values, "value", "left_semi").select("ord", "line_no", "begin", "finish")
    return keys.unionByName(direct).unionByName(rescan(examples, values)).distinct()


def found(examples: DataFrame) -> DataFrame:
    return spans(examples).select("ord", "line_no").distinct()


def redact_text(text: str, places: list[tuple[int, int]]) -> str:
    """The text with the given spans masked; quotes, joins, escapes and line ends inside a span stay."""
    out, at = [], 0
    for a, b in sorted(places):
        if b <= at:
            continue
        a = max(a, at)
        part = text[a:b]
        if PRIVATE.match(part):
            head = PRIVATE.match(part).end()
            part = part[:head] + re.sub(r"(\\[nrt])|[A-Za-z0-9+/=]{4,}", lambda m: m.group(1) or MASK, part[head:])
        elif re.search(r"[\"']\s*[+.]?\s*[\"']", part):
            part = re.sub(r"[^\"'+\s.]+", MASK, part)
        else:
            part = MASK
        out += [text[at:a], part]
        at = b
    return "".join([*out, text[at:]])


def redacted(examples: DataFrame) -> DataFrame:
    """(ord, n_spans, text): every row; a row without credentials keeps its text, a null text stays null."""
    places = spans(examples).groupBy("ord").agg(F.collect_list(F.struct("begin", "finish")).alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(o, 0 if p is None else len(p), t if p is None or t is None else redact_text(t, [(x["begin"], x["finish"]) for x in p])) for o, t, p in b.itertuples(index=False)]
            yield pd.DataFrame(got, columns=["ord", "n_spans", "text"])

    return examples.select("ord", "text").join(places, "ord", "left").mapInPandas(run, "ord bigint, n_spans int, text string")
