"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_pass, slices, strings

TREES, DEPTH, MIN_LEAF = 40, 8, 3
#: Bound of the labelled findings that training takes.
MAX_FINDINGS = 20_000
MASK = "[SECRET]"

# Names that stand before a secret, and words of ordinary text or code.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private_key")
ORDINARY_WORDS = ("the and for with from this that not license version public general apache example test sample dummy placeholder "
                  "changeme none null true false your here page http https www com net org index html default user name value key "
                  "der die und das von que los las del para les des une est dans pour").split()
#: Words before a value that say it is a digest, an identifier or data, not a secret.
DIGEST_WORDS = ("commit sha sha1 sha256 sha384 sha512 md5 crc32 hash checksum digest etag revision rev blob tree parent object uuid guid id ids "
                "image base64 integrity fingerprint build version serial isbn order ticket request trace span session_id png jpeg jpg gif").split()
#: Prefixes of public key formats with what follows them.
KEY_FORMATS = (r"(?:AKIA|ASIA)[A-Z0-9]{12,}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_\w{20,}", r"sk-[A-Za-z0-9_-]{20,}", r"xox[abprs]-[A-Za-z0-9-]{10,}",
               r"AIza[A-Za-z0-9_-]{30,}", r"glpat-[A-Za-z0-9_-]{16,}", r"hf_[A-Za-z0-9]{20,}",
               r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?")
_NAME = "|".join(SECRET_NAMES)
#: What stands behind a telling name (bare, with a suffix, or a quoted key such as "name": or ['name'] =), the body of a private key, a password in a URL,
#: a bearer token, a known key format, or a long run of key characters with a digit. Every part begins with a literal or a boundary, so a scan is linear.
CANDIDATE = re.compile(
    rf"(?:{_NAME})(?:[_-][A-Za-z0-9_-]{{0,16}}+)?[\"']?\]?[\x20\t]{{0,3}}[=:][\x20\t]{{0,3}}[\"']?(?:(?:bearer|basic)\x20{{1,3}})?(?P<value>[^\s\"',;]{{6,}})"
    r"|(?<=PRIVATE\x20KEY-----)(?P<pem>[^-]{16,}+)(?=-----END)"
    r"|(?<=://)[^\s/:@]{1,64}+:(?P<url>[^\s/@]{3,}+)(?=@)"
    r"|(?<![A-Za-z0-9])(?:bearer|basic)\x20{1,3}(?P<bearer>[A-Za-z0-9._~+/=-]{8,}+)"
    rf"|(?P<key>(?<![A-Za-z0-9])(?:{'|'.join(KEY_FORMATS)})(?![A-Za-z0-9]))"
    r"|(?P<run>(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9+/_-]))", re.IGNORECASE)
_DIGIT = re.compile("[0-9]")
_TELLS = re.compile(r"[=:]|AKIA|ASIA|bearer|basic", re.IGNORECASE)
KINDS = ("name", "key", "run", "url", "bearer", "pem")
_WORD = re.compile(r"\w+")
_HEX = re.compile("[0-9a-fA-F]+")
_UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
FEATURES = ("length", "digits", "upper", "lower", "other", "hex", "entropy", "distinct", "change_class", "same_class", "letter_pairs",
            "covered", "ordinary", "named", "key_format", "assigned", "quoted", "name_before", "ordinary_before", "ordinary_after",
            "digits_before", "path_depth", "path_is_test", "path_is_code", "luhn_digits", "in_url", "bearer", "pem", "digest_before", "digest_shape",
            "uuid_shape", "letters_and_digits", "signs_inside", "path_signs")


@dataclass
class Finding:
    """A candidate: where it is, what it looks like, and what stands around it."""

    start: int
    end: int
    kind: str
    value: str
    before: str
    after: str


def candidates(text: str | None) -> list[Finding]:
    """Candidate spans (code points, end exclusive) of a whole text, left to right, without overlaps; what is masked is none."""
    if not text or not (_DIGIT.search(text) or _TELLS.search(text)):
        return []
    found = []
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup if m.lastgroup != "value" else "name"
        start, end = m.span("value" if kind == "name" else kind)
        if MASK in text[start:end]:
            continue
        found.append(Finding(start, end, kind, text[start:end], text[max(0, start - 48):start], text[end:end + 48]))
    return found


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def finding_features(finding: Finding, path: str | None = None) -> list[float]:
    value = finding.value
    n = max(len(value), 1)
    classes = [_class(c) for c in value]
    pairs = list(zip(classes, classes[1:], strict=False))
    counts = np.array([k for _, k in sorted(Counter(value).items())])
    share = counts / n
    lowered = value.lower()
    covered = sum(len(w) for w in ORDINARY_WORDS if len(w) > 3 and w in lowered)
    before, after = _WORD.findall(finding.before.lower()), _WORD.findall(finding.after.lower())
    ordinary = set(ORDINARY_WORDS)
    tail = finding.before.rstrip(" \t\"'")
    path = (path or "").lower()
    return [
        len(finding.value), classes.count(0) / n, classes.count(1) / n, classes.count(2) / n, classes.count(3) / n,
        sum(c in "0123456789abcdef" for c in lowered) / n, -float(np.sum(share * np.log2(share))) if value else 0.0, len(counts) / n,
        sum(a != b for a, b in pairs) / n, sum(a == b for a, b in pairs) / n, sum(a == b == 2 for a, b in pairs) / n,
        min(1.0, covered / n), float(lowered in ordinary), float(finding.kind == "name"), float(finding.kind == "key"),
        float(tail[-1:] in ("=", ":")), float(finding.before[-1:] in ("\"", "'")),
        float(any(name in "_".join(before[-2:]) for name in SECRET_NAMES)), sum(w in ordinary for w in before[-4:]),
        sum(w in ordinary for w in after[:4]), float(any(w.isdigit() for w in before[-2:])), path.count("/"),
        float("test" in path or "example" in path), float(path.rsplit(".", 1)[-1] in ("py", "js", "env", "yml", "yaml", "json", "ini")),
        float(value.isdigit()), float(finding.kind == "url"), float(finding.kind == "bearer"), float(finding.kind == "pem"),
        sum(w in DIGEST_WORDS for w in before[-3:]) + float(lowered.startswith(("sha1-", "sha256-", "sha384-", "sha512-", "md5-"))),
        float(bool(_HEX.fullmatch(value)) and n in _DIGEST_LENGTHS), float(bool(_UUID.fullmatch(value))),
        float(classes.count(0) > 0 and classes.count(1) + classes.count(2) > 0), sum(c in "!#$%&*?@^~" for c in value), sum(c in "/._-" for c in value) / n]


@dataclass
class Forest:
    """Trees as arrays, complete to ``DEPTH`` levels: feature and limit of inner nodes, probability of leaves."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        return self.leaf[trees, node - self.feature.shape[1]].mean(axis=1)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """Bagged trees by Gini impurity, a random subset of features at each split."""
    rng = np.random.default_rng(seed)
    inner, columns = 2 ** depth - 1, x.shape[1]
    tried = max(2, int(np.sqrt(columns)))
    feature, limit = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, 2 ** depth))
    for t in range(trees):
        bag = rng.integers(0, len(y), len(y))
        held = {0: bag}
        for node in range(inner):
            own = held.pop(node)
            best = (1e-12, 0, np.inf)
            if len(own) >= 2 * MIN_LEAF and 0 < y[own].sum() < len(own):
                for j in rng.choice(columns, tried, replace=False):
                    order = np.argsort(x[own, j], kind="stable")
                    v, labels = x[own, j][order], y[own][order]
                    k = np.arange(1, len(own))
                    ones = labels.cumsum()[:-1]
                    left = 2 * ones * (k - ones) / k
                    right_ones, right = labels.sum() - ones, len(own) - k
                    gain = 2 * labels.sum() * (len(own) - labels.sum()) / len(own) - left - 2 * right_ones * (right - right_ones) / right
                    gain[(v[1:] == v[:-1]) | (k < MIN_LEAF) | (right < MIN_LEAF)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, (v[i] + v[i + 1]) / 2)
            feature[t, node], limit[t, node] = best[1], best[2]
            goes = x[own, best[1]] > best[2]
            for child, rows in ((2 * node + 1, own[~goes]), (2 * node + 2, own[goes])):
                if child < inner:
                    held[child] = rows
                else:
                    leaf[t, child - inner] = y[rows].mean() if len(rows) else 0.0
    return Forest(feature, limit, leaf)


def made_up_findings(seed: int = 11, n: int = 150) -> list[tuple[Finding, str, int]]:
    """Labelled findings by kind: keys, tokens and passwords (1); what only looks like them (0)."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, size: "".join(rng.choice(list(chars), size))
    syllables = "er in th an on re at en nd ti es or te of ed is it al ar st".split()
    words = lambda k: " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    out = []

    def add(kind: str, lead: str, value: str, tail: str, path: str, label: int) -> None:
        before = words(4) + " " + lead
        out.append((Finding(0, len(value), kind, value, before[-48:], (tail + " " + words(4))[:48]), path, label))

    for _ in range(n):
        path = rng.choice(["src1", "app/config.py", "deploy/prod.env", "notes/readme.md", "src19"])
        name = rng.choice(["password", "token", "api_key", "secret", "auth_token"])
        sign, quote = rng.choice(["=", " = ", ": ", ":"]), rng.choice(["", '"', "'"])
        add("key", "", "AKIA" + pick(upper + digits, 16), "", path, 1)
        add("name", name + sign + quote, pick("0123456789abcdef", rng.integers(16, 65)), quote, path, 1)
        add("name", name + sign + quote, pick(lower + upper + digits, rng.integers(12, 48)), quote, path, 1)
        add("run", name + " ", pick(lower + upper + digits + "+/", rng.integers(32, 64)), "", path, 1)
        value = rng.choice(["changeme", "your_token_here", "placeholder", "password", "example", "xxxxxxxxxx", "<token>", "None", "${TOKEN}", "null"])
        add("name", name + sign + quote, value + rng.choice(["", "1", "123"]), quote, rng.choice([path, "tests/test_auth.py"]), 0)
        add("name", name + sign, "".join(rng.choice(syllables, rng.integers(3, 7))), "", path, 0)
        add("run", "", pick(digits, rng.integers(16, 20)), "", path, 0)
        add("run", "", "-".join("".join(rng.choice(syllables, 3)) for _ in range(3)) + pick(digits, 2), "", path, 0)
        add("run", "https:", "//www/" + "/".join("".join(rng.choice(syllables, 3)) for _ in range(3)) + "/" + pick(digits, 3), "", path, 0)
        add("run", "", pick(lower, 8) + "_" + pick(lower, 8) + pick(digits, 1), "", path, 0)
        add("run", "+1-", "-".join((pick(digits, 3), pick(digits, 4), pick(digits, 4), pick(digits, 4))), "", path, 0)
    # Quoted keys, from random numbers of their own so that the rows above stay as they are.
    rng = np.random.default_rng(seed + (1 << 20))
    for _ in range(n):
        path = rng.choice(["src1", "app/config.json", "deploy/prod.yml", "notes/readme.md", "src19"])
        name = rng.choice(["password", "token", "api_key", "secret", "auth_token"])
        key, mark = rng.choice(['"', "'"], 2)
        lead = (f"{{{key}{name}{key}" if rng.random() < 0.6 else f"d[{key}{name}{key}]") + rng.choice([": ", ":", " = ", "=", " : "]) + mark
        tail = mark + rng.choice(["}", "", ","])
        add("name", lead, pick(lower + upper, rng.integers(12, 40)), tail, path, 1)
        add("name", lead, pick(lower + upper + digits, rng.integers(8, 40)), tail, path, 1)
        core = list(pick(lower + upper, rng.integers(5, 12)) + pick(digits, rng.integers(1, 4)) + pick("!#$%&*+-.?@^_", rng.integers(1, 3)))
        add("name", lead, "".join(rng.permutation(core)), tail, path, 1)
        value = rng.choice(["changeme", "your_token_here", "placeholder", "password", "example", "xxxxxxxxxx", "<token>", "None", "${TOKEN}", "null"])
        add("name", lead, value + rng.choice(["", "1", "123"]), tail, rng.choice([path, "tests/test_auth.py"]), 0)
        add("name", lead, "".join(rng.choice(syllables, rng.integers(3, 7))), tail, path, 0)
        add("name", lead, "_".join("".join(rng.choice(syllables, 3)) for _ in range(2)), tail, path, 0)
    # Digests, identifiers and data against passwords, tokens and keys, again from random numbers of their own.
    rng = np.random.default_rng(seed + (1 << 21))
    base64, hexes = lower + upper + digits + "+/", "0123456789abcdef"
    word = lambda a, b: "".join(rng.choice(syllables, rng.integers(a, b)))
    for _ in range(n):
        path = rng.choice(["src1", "app/config.py", "deploy/prod.env", "notes/readme.md", "src19"])
        name = rng.choice(["password", "passwd", "pwd", "PASSWORD", "DB_PASSWORD", "secret"])
        sign, quote = rng.choice(["=", " = ", ": ", ":"]), rng.choice(["", '"', "'"])
        digest = rng.choice(["commit ", "sha1 ", "sha256:", "sha256 ", "md5: ", "md5 ", "checksum ", "checksum: ", "digest sha256:", "tree ", "parent ", "hash ",
                             "etag ", 'ETag: "', "blob ", "revision ", "merge of ", "at ", "object ", ""])
        add("run", digest, pick(hexes, rng.choice(_DIGEST_LENGTHS)), "", path, 0)
        add("run", digest, pick(hexes, rng.choice([40, 64, 32])), "", path, 0)
        uuid = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
        add("run", rng.choice(["id ", "id: ", "uuid ", "uuid=", "request ", "trace ", "session ", "guid ", "user ", ""]), uuid, "", path, 0)
        add("run", rng.choice(['integrity="', "integrity: ", ""]), rng.choice(["sha256-", "sha384-", "sha512-"]) + pick(base64, rng.integers(43, 87)), "=", path, 0)
        add("run", rng.choice(["data:image/png;base64,", "data:image/jpeg;base64,", "src=data:image/gif;base64,"]), rng.choice(["iVBORw0KGgo", "/9j/4AAQSkZJRg", "R0lGODlh"]) + pick(base64, rng.integers(40, 200)), "", path, 0)
        add("run", rng.choice(["order ", "ticket ", "isbn ", "build ", "version ", "serial "]), "-".join(pick(digits, rng.integers(3, 6)) for _ in range(4)), "", path, 0)
        add("bearer", rng.choice(["bearer ", "basic ", "Basic "]), word(4, 8), rng.choice([" ", ".", ""]), path, 0)
        spoken = word(2, 4) + pick(digits, rng.integers(1, 4)) + rng.choice(["", word(1, 3), pick("!#$%&*?@^", 1)])
        add("name", name + sign + quote, spoken, quote, path, 1)
        add("name", name + sign + quote, spoken.capitalize() + pick("!#$%&*?@", rng.integers(0, 3)), quote, path, 1)
        for _ in range(2):
            parts = [word(1, 3) for _ in range(rng.integers(1, 4))]
            add("name", name + sign + quote, "".join(p + pick(digits, rng.integers(i == 0, 3)) for i, p in enumerate(parts)), quote, path, 1)
        add("name", rng.choice(["token", "api_key", "secret", "access_key"]) + sign + quote, rng.choice([uuid, pick(hexes, 40), pick(hexes, 32)]), quote, path, 1)
        add("key", rng.choice(["", "token ", "use "]), rng.choice(["ghp_", "gho_", "glpat-", "hf_", "sk-", "xoxb-", "AIza"]) + pick(lower + upper + digits, rng.integers(24, 40)), "", path, 1)
        jwt = "eyJ" + pick(base64[:62], rng.integers(15, 40)) + "." + pick(base64[:62], rng.integers(20, 60)) + "." + pick(base64[:62] + "_-", 43)
        add("key", rng.choice(["", "jwt "]), jwt, "", path, 1)
        add("bearer", rng.choice(["Authorization: Bearer ", "Bearer "]), rng.choice([jwt, pick(base64[:62], rng.integers(20, 50)), pick(hexes, 32),
                                                                                     ".".join(pick(base64[:62], 8) for _ in range(3))]), "", path, 1)
        add("url", rng.choice(["postgres://", "mysql://", "https://", "amqp://", "redis://"]) + word(1, 3) + ":", rng.choice([spoken, pick(base64[:62], 14), word(2, 4)]), "@" + word(2, 3), path, 1)
        add("url", "https://" + word(1, 3) + ":", rng.choice(["${PASS}", "<password>", "password", "xxxxx", "$TOKEN", "{token}", "..."]), "@" + word(2, 3), path, 0)
        add("pem", "-----BEGIN RSA PRIVATE KEY-----", "\n" + "\n".join(pick(base64, 64) for _ in range(3)) + "\n", "-----END", path, 1)
        add("pem", "-----BEGIN PRIVATE KEY-----", rng.choice(["\n... your key here ...\n", "\n<private key goes here>\n", "\nexample example example\n"]), "-----END", path, 0)
    return out


def train(findings: DataFrame | None = None, most: int = MAX_FINDINGS) -> Forest:
    """A forest from labelled findings: rows of ``value``, ``kind``, ``before``, ``after``, ``path``, ``label``.

    Equal rows count once. Of a table of findings, about ``most`` rows chosen by hash are used; without one, made-up
    findings. Rows without value or label are left out; if none is left, nothing is taken for a secret.
    """
    if findings is None:
        rows = made_up_findings()
    else:
        columns = ["value", "kind", "before", "after", "path", "label"]
        known = findings.where("value IS NOT NULL AND label IS NOT NULL").select(*columns).distinct()
        total, parts = known.count(), 1 << 40
        chosen = known.where(F.pmod(F.xxhash64(*columns), F.lit(parts)) < int(parts * min(1.0, most / max(total, 1))))
        rows = [(Finding(0, len(r["value"]), r["kind"] or "run", r["value"], r["before"] or "", r["after"] or ""), r["path"], int(r["label"]))
                for r in chosen.collect()]
        rows.sort(key=lambda r: (r[0].value, r[0].before, r[0].after, r[0].kind, r[1] or "", r[2]))
    if not rows:
        return Forest(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)))
    x = np.array([finding_features(f, p) for f, p, _ in rows])
    return fit_forest(x, np.array([label for _, _, label in rows], float))


def judged(text: str | None, path: str | None, forest: Forest) -> list[tuple[Finding, float]]:
    found = candidates(text)
    if not found:
        return []
    return list(zip(found, forest.scores(np.array([finding_features(f, path) for f in found])).tolist(), strict=True))


def find_secrets(docs: DataFrame, forest: Forest, path: str = "source", bar: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, end, kind, value, score, is_secret.

    ``score`` is the forest's probability; under ``bar`` a candidate counts as a false positive, and stays in
    the result so marked. Whole texts are scanned; null and empty ones give no rows, and so does an empty table.
    Repeated rows give their findings each. Further columns aren't read.
    """

    def run(batches):
        for part in slices(batches):
            rows = []
            for doc_id, text, place in zip(part.column(0).to_pylist(), strings(part), part.column(2).to_pylist(), strict=True):
                rows += [(doc_id, f.start, f.end, f.kind, f.value, s, s >= bar) for f, s in judged(text, place, forest)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "start", "end", "kind", "value", "score", "is_secret"])

    ready = docs.select("doc_id", "text", F.col(path).cast("string").alias("path"))
    return arrow_pass(ready, ["doc_id", "text", "path"], run,
                      "doc_id bigint, start bigint, end bigint, kind string, value string, score double, is_secret boolean")


def mask_secrets(docs: DataFrame, forest: Forest, path: str = "source", bar: float = 0.5) -> DataFrame:
    """``docs`` with each secret's characters replaced by ``MASK`` in ``text``; all rows and columns stay."""
    order = docs.columns

    def work(part):
        out = []
        for text, place in zip(strings(part), strings(part, path), strict=True):
            pieces, last = [], 0
            for f, s in judged(text, None if place is None else str(place), forest):
                if s >= bar:
                    pieces += [text[last:f.start], MASK]
                    last = f.end
            out.append(text if not pieces else "".join([*pieces, text[last:]]))
        return [pa.array(out, pa.string())]

    return append_columns(docs, work, [T.StructField("text", T.StringType())]).select(*order)
