"""Personal data, also in disguise, with spans in the source's own characters.

Plain identifiers are found in the text as it is. Then transducers rewrite a text and remember where each character came from:
the first turns homoglyphs, full-width forms, odd spaces and dashes and escapes of @ and . into plain ones and drops invisible characters;
the second turns at/dot disguises, letters that stand for digits and spelled digits into the characters they stand for. Identifiers found in the rewritten text that hold
a rewritten character are mapped back to source spans and added. Every pass reads a text in time in proportion to its length: no pattern
has two quantifiers side by side that take the same characters, and none is tried again from within what it has read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, sliced, table, texts, tidy

KINDS = ("email", "ip", "card", "phone")

#: Letters that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһѵԛԝАВЕКМНОРСТУХІЈЅοανιρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhvqwABEKMHOPCTYXIJSoaviptukABEZHIKMNOPTYX"))
#: digits' names in English, Spanish, French and German.
DIGITS = {w: str(d) for d, ws in enumerate(("zero oh cero zéro null", "one uno un eins", "two dos deux zwei", "three tres trois drei", "four cuatro quatre vier", "five cinco cinq fünf", "six seis sechs", "seven siete sept sieben", "eight ocho huit acht", "nine nueve neuf neun")) for w in ws.split()}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the plain identifiers: leftmost and non-overlapping within a kind, in order.

    Emails are looked for around each @, so that a long run of letters is read once.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewritten:
    """A text after edits (start, end, new), which are in order and don't overlap."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.src, self.edited, n, done = [], [], [], [], 0, 0
        self.starts = [a for a, _, _ in edits]
        for a, b, new in [*edits, (len(text), len(text), "")]:
            for s, e, t, is_edit in ((done, a, text[done:a], False), (a, b, new, True)):
                if t:
                    parts.append(t)
                    self.at.append(n)
                    self.src.append((s, e))
                    self.edited.append(is_edit)
                    n += len(t)
            done = b
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span, and whether it holds an edit."""
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        a = self.src[i][0] + (0 if self.edited[i] else start - self.at[i])
        b = self.src[j][1] if self.edited[j] else self.src[j][0] + end - self.at[j]
        k = bisect.bisect_left(self.starts, a)
        return a, b, k < len(self.starts) and self.starts[k] < b


_ODD = re.compile("[^\x00-\xa0¡-¬®-˿]|[\xa0\xad]")


def _plain(c: str) -> str | None:
    """The ASCII character that a character stands for, "" for an invisible one, None for one that stays."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    kind = unicodedata.category(c)
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Pd" or c == "−":
        return "-"
    if c in "。．․":
        return "."
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else None


#: How HTML and URLs write @ and the full stop.
_ESCAPE = re.compile(r"(?P<at>&#0{0,5}64;|&#x0{0,5}40;|&commat;|%40)|&#0{0,5}46;|&#x0{0,5}2e;|&period;|%2e", re.I)


def characters(text: str) -> list[tuple[int, int, str]]:
    edits = [] if text.isascii() else [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _plain(m[0])) is not None]
    if "&" in text or "%" in text:
        edits = sorted(edits + [(m.start(), m.end(), "@" if m["at"] else ".") for m in _ESCAPE.finditer(text)])
    return edits


_OPEN, _CLOSE = r"[ \t]*+[(\[{<][ \t]*+", r"[ \t]*+[)\]}>][ \t]*+"
_AT_WORD, _DOT_WORD = "(?:at|arroba|ät)", "(?:d[o0]t|punto|punkt|point)"
_DOT = rf"{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|[ \t]++{_DOT_WORD}[ \t]++"
_HOST = "[A-Za-z0-9-]++"
#: What may stand for an @, each with what is around it: in brackets, spaced, the plain one, the bare word. A run of blanks is tried once.
_ANCHOR = re.compile(rf"(?<![ \t])(?:(?P<bracketed>{_OPEN}(?:{_AT_WORD}|@){_CLOSE})|(?P<spaced>[ \t]++@[ \t]++)|(?P<word>[ \t]++(?:{_AT_WORD})[ \t]++))|(?P<plain>@)", re.I)
_ANCHOR_HINT = re.compile(rf"@|[(\[{{<][ \t]*+{_AT_WORD}|[ \t]{_AT_WORD}[ \t]++{_HOST}(?:\.[A-Za-z]|{_DOT})", re.I)
_HOSTS = re.compile(rf"{_HOST}(?:(?:\.|{_DOT}){_HOST})*+", re.I)
_DOTS = re.compile(rf"(?<![ \t])(?:{_DOT})", re.I)
_DOT_HINT = re.compile(r"[-_ \t(\[{<](?:d[o0]t|punto|punkt|point)[-_ \t)\]}>]|[(\[{<][ \t]*+\.", re.I)
_DOT_NAMES = frozenset(("dot", "d0t", "punto", "punkt", "point"))
_LETTERS, _NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0"), _LOCAL - {"."}
#: Words before "@" or "at" that are no mailbox; mailboxes; hosts of mailboxes.
NO_MAILBOX = frozenset(
    "a about all also always and anything are around as available back be been bought book buy by call came check click come day directly do download each email event events find first for found free from full get go going got happening have he held her here him his home hosted i in info information is it its join just last launch learn live located look looking lunch made me meet meeting members more my near new news night now of off offer on one online only open or order our out over page party people posted prices published read register sale sales see seen sell she shop shopping show sign site sold something start started starting stay staying stop stopped store submit subscribe tell that the their them there these they things this tickets time today tomorrow tonight up us via view visit visiting was watch we website week were what when where with work working you your".split()
)
MAILBOXES = frozenset("admin billing contact enquiries hello info jobs mail noreply office postmaster press sales service support user webmaster".split())
MAIL_HOSTS = frozenset("aol.com gmail.com gmx.de gmx.net googlemail.com hotmail.com icloud.com live.com mail.ru msn.com outlook.com proton.me protonmail.com web.de yahoo.com yandex.ru".split())


def _back(text: str, at: int, among) -> int:
    while at and text[at - 1] in among:
        at -= 1
    return at


def _dot_before(text: str, end: int) -> int | None:
    """Where a full stop, plain or disguised, begins that ends here."""
    if end and text[end - 1] == ".":
        return end - 1
    at = _back(text, end, " \t")
    if at and text[at - 1] in ")]}>":
        at = _back(text, at - 1, " \t")
        word = at - 1 if at and text[at - 1] == "." else _back(text, at, _LETTERS)
        if text[word:at].lower() in _DOT_NAMES or text[word:at] == ".":
            at = _back(text, word, " \t")
            if at and text[at - 1] in "([{<":
                return _back(text, at - 1, " \t")
        return None
    word = _back(text, at, _LETTERS)
    if at < end and text[word:at].lower() in _DOT_NAMES:
        start = _back(text, word, " \t")
        return start if start < word else None
    return None


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits of disguised addresses: a name, what stands for an @, and a host with a full stop, plain or disguised.

    An @ in brackets takes any host; a plain @ one with a disguised full stop. A spaced @ needs a name that is no common word before it, and a host
    that isn't a website's; a bare word, a disguised full stop in the host, or a name that can only be a mailbox.
    """
    edits, done = [], 0
    for m in _ANCHOR.finditer(text):
        host = _HOSTS.match(text, m.end())
        if not host or host.end() - host.start() < 3:
            continue
        hidden = [d.span() for d in _DOTS.finditer(text, host.start(), host.end())]
        if not hidden and (m["plain"] or "." not in host[0]):
            continue
        start, dots = _back(text, m.start(), _NAME_CHARS), []
        if start == m.start():
            continue
        while (dot := _dot_before(text, start)) is not None and (name := _back(text, dot, _NAME_CHARS)) < dot:
            if dot + 1 < start:
                dots.append((dot, start))
            start = name
        if start < done:
            continue
        local, site = text[start : m.start()], host[0].lower()
        common = local.lower() in NO_MAILBOX - MAILBOXES
        if m["word"] and common:
            continue
        if m["spaced"] and not hidden and (common or site.startswith("www.")):
            continue
        if m["word"] and not hidden:
            known = local.lower() in MAILBOXES or site in MAIL_HOSTS
            marked = any(c in "._%+-0123456789" for c in local) or m[0].strip().isupper()
            if site.startswith("www.") or not (known or marked) or not re.search(r"\.[a-z]{2,}$", site):
                continue
        done = host.end()
        edits += [(a, b, ".") for a, b in reversed(dots)]
        if not m["plain"]:
            edits.append((m.start(), m.end(), "@"))
        edits += [(a, b, ".") for a, b in hidden]
    return edits


#: The same with dashes or underscores in place of spaces; numbers with disguised dots; "plus" before a number.
_HYPHENED = re.compile(r"(?<=[A-Za-z0-9.%+])[-_](?:at|arroba)[-_][A-Za-z0-9]++(?:[-_](?:dot|punto|punkt|point)[-_][A-Za-z0-9]++)++", re.I)
_HYPHENED_PART = re.compile(r"(?P<at>[-_](?:at|arroba)[-_])|(?P<dot>[-_](?:dot|punto|punkt|point)[-_])", re.I)
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}+(?:(?:\.|{_DOT})[0-9]{{1,3}}+){{3}}(?![0-9])", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ \t]++(?=[0-9](?:[ ().-]{0,3}[0-9]){8,14}(?![0-9]))", re.I)
_NAME = "|".join(sorted(DIGITS, key=len, reverse=True))
#: Between two digits: a dot or dash by name, dots and brackets, or blanks with a dash or comma; each pattern takes a run of blanks once.
_PARTING = r"(?:[ \t]++(?:dot|point|punto|punkt|dash|hyphen)[ \t]++|[ \t]*+[.()]++[ \t]*+|[ \t]*+(?:[-,][ \t]*+)?)"
#: A run of digits' names and digits with such partings; optionally "plus" before. Never steps back.
_DIGIT = rf"(?:(?:(?:double|triple)[ \t]++)?(?:{_NAME})(?!\w)|[0-9]++)"
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus[ \t]++|\+[ \t]*+))?{_DIGIT}(?:{_PARTING}{_DIGIT})++", re.I)
_BETWEEN = rf"{_PARTING}(?:(?:double|triple)[ \t]++)?"
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_NAME})(?!\w){_BETWEEN}(?:[0-9]|(?:{_NAME})(?!\w))|[0-9]{_BETWEEN}(?:{_NAME})(?!\w)")
#: Any name at all, in a text in lower case; quick.
_NAME_HINT = re.compile(rf"\b(?=[{''.join(sorted({w[0] for w in DIGITS}))}])(?:{_NAME})\b")
#: Digits with letters that look like them, in groups; letters count as digits only beside a digit of their group.
_LOOKALIKE_HINT = re.compile("[0-9][OolI]|[OolI][0-9]")
_LOOKALIKE = re.compile(r"(?<![A-Za-z0-9])[0-9OolI]++(?:[ .()-]{1,2}+[0-9OolI]++)*+")
_GROUP = re.compile("[0-9OolI]+")
_STOP = re.compile(r"\.[ \t]++")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w]", re.I)


def _names(run: str) -> int:
    return sum(t[0].lower() in DIGITS for t in _TOKEN.finditer(run))


def _spelled(run: str, at: int) -> list[tuple[int, int, str]]:
    """Edits of a run of spelled digits and digits that begins at `at`: names become digits, blanks and commas go, dots and dashes are kept."""
    edits, times = [], 1
    for t in _TOKEN.finditer(run):
        a, b, w = at + t.start(), at + t.end(), t[0].lower()
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
            edits.append((a, b, ""))
        elif w in DIGITS:
            edits.append((a, b, DIGITS[w] * times))
            times = 1
        elif w == "plus":
            edits.append((a, b, "+"))
        elif w in ("dot", "point", "punto", "punkt"):
            edits.append((a, b, "."))
        elif w in ("dash", "hyphen"):
            edits.append((a, b, "-"))
        elif w in " \t,":
            edits.append((a, b, ""))
    return edits


def _parted(run: str, at: int, whole: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same where full stops before blanks part the digits (three names at least, they go) or end a sentence (fewer, the run ends there).
    whole: the run's _spelled() edits if it has three names at least, else none."""
    stops = list(_STOP.finditer(run))
    if whole:
        return sorted(whole + [(at + m.start(), at + m.start() + 1, "") for m in stops]) if stops else whole
    out, done = [], 0
    for start, end in [*(m.span() for m in stops), (len(run), len(run))]:
        if _names(run[done:start]) and _SPELLED.fullmatch(run, done, start):
            out += _spelled(run[done:start], at + done)
        done = end
    return out


def lookalikes(text: str) -> list[tuple[int, int, str]]:
    """Edits of O, o, l and I in groups with a digit, in runs of groups that are mostly digits; a group that goes on in other letters
    is a word."""
    out = []
    for run in _LOOKALIKE.finditer(text):
        if 2 * sum(c.isdigit() for c in run[0]) >= sum(c.isalnum() for c in run[0]):
            for g in _GROUP.finditer(text, run.start(), run.end()):
                if any(c.isdigit() for c in g[0]) and not text[g.end() : g.end() + 1].isalpha():
                    out += [(k, k + 1, "0" if text[k] in "Oo" else "1") for k in range(g.start(), g.end()) if text[k] in "OolI"]
    return out


def disguises(text: str) -> list[list[tuple[int, int, str]]]:
    """Edits for at/dot disguises within an address, and for runs of spelled digits: those of runs with three names or more; and, where they
    differ, those of all runs with a name. Each is searched, since a name next to a number may also be a word of the sentence."""
    edits = addresses(text) if _ANCHOR_HINT.search(text) else []
    if _DOT_HINT.search(text):
        edits += _free(edits, [(m.start() + t.start(), m.start() + t.end(), "@" if t["at"] else ".") for m in _HYPHENED.finditer(text) for t in _HYPHENED_PART.finditer(m[0])])
        edits += _free(edits, [(*t.span(), ".") for m in _DOTTED.finditer(text) for t in _DOTS.finditer(text, m.start(), m.end())])
    edits += _free(edits, [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)])
    if _LOOKALIKE_HINT.search(text):
        edits += _free(edits, lookalikes(text))
    if _NAME_HINT.search(lower := text.lower()) and _SPELLED_HINT.search(lower):
        many, every = [], []
        for m in _SPELLED.finditer(text):
            if n := _names(m[0]):
                whole = _spelled(m[0], m.start()) if n >= 3 else []
                many += whole
                every += _parted(m[0], m.start(), whole)
        if every != many:
            return [sorted(edits + _free(edits, many)), sorted(edits + _free(edits, every))]
        edits += _free(edits, many)
    return [sorted(edits)]


def _free(edits: list, more: list) -> list:
    """Those of more that meet none of the edits. Both are few: they are of found disguises only."""
    taken = sorted((a, b) for a, b, _ in edits)
    starts = [a for a, _ in taken]
    out = []
    for e in more:
        k = bisect.bisect_left(starts, e[1])
        if not k or taken[k - 1][1] <= e[0]:
            out.append(e)
    return out


def disguised(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifiers that only the rewritten text shows, as spans of the source."""
    first_edits = characters(text)
    first = Rewritten(text, first_edits)
    out: set = set()
    for k, second_edits in enumerate(disguises(first.text)):
        if not first_edits and not second_edits:
            continue
        second, made = Rewritten(first.text, second_edits), set()
        for start, kind, end in find(second.text):
            a, b, changed = second.back(start, end)
            if k and kind == 1 and _IP.search(first.text, a, b):  # whole without the name after it
                continue
            a, b, changed_too = first.back(a, b)
            if changed or changed_too:
                made.add((a, kind, b))
        # full stops between the digits of a longer identifier make no addresses of its parts
        longer = sorted((m[0], m[2]) for m in made - out if m[1] > 1)
        ends = list(itertools.accumulate((e for _, e in longer), max, initial=0))
        out = made | {s for s in out if s[1] != 1 or ends[bisect.bisect_right(longer, (s[0], len(text) + 1))] < s[2]}
    return sorted(out)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain ones, all of them), in order. Plain ones stay; a disguised one is left out only where it lies within a plain one of its kind."""
    plain = find(text)
    ends = [([a for a, k, _ in plain if k == kind], [b for _, k, b in plain if k == kind]) for kind in range(len(KINDS))]

    def within(a: int, kind: int, b: int) -> bool:  # plain ones of a kind don't overlap
        at = bisect.bisect_right(ends[kind][0], a) - 1
        return at >= 0 and b <= ends[kind][1][at]

    return plain, sorted({*plain, *(s for s in disguised(text) if not within(*s))})


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    out, done = [], 0
    for a, k, b in found:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k]}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id; n_email, n_ip, n_card, n_phone (plain ones); base_sha256 (of the plain spans as kind:start:end); spans (all of them).

    docs: doc_id, text. A row for every row, equal ones too; null and empty texts have no spans; a null doc_id stays null. Texts are
    searched whole, in time in proportion to their length. Other columns are not read. An empty table gives an empty one.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in sliced(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                plain, every = spans(text)
                rows.append((doc_id, *(sum(s[1] == k for s in plain) for k in range(4)), hashlib.sha256(written(plain).encode()).hexdigest(), written(every)))
            yield table(dict(zip(FOUND.names, zip(*rows))), FOUND)
        tidy()

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span masked in text; all columns, whatever their names, and all rows stay: null and empty texts as they are,
    equal rows alike; very long texts are searched whole. An empty table gives an empty one."""
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in sliced(batches):
            new = [None if t is None else masked(t, spans(t)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
        tidy()

    return docs.mapInArrow(run, docs.schema)
