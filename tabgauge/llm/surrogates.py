"""Personal data replaced by keyed, type-consistent surrogates.

1. Entities (e-mail, account, card, phone, IPv4 and social-security numbers, names) are found in every text; distinct entities are gathered by one
   shuffle. An entity is compared in a normal form, so ``+1 (017) 555-7713`` and ``+1 017 555 7713`` are one. Card and account numbers count if
   their checksums hold.
2. Numbers and addresses: a keyed permutation (a Feistel network over HMAC-SHA256, walked until it falls into the form again) of all values of the
   entity's form, so different entities of a form get different surrogates. Letters stay letters of their script and case, digits digits, marks stay; country codes, top-level domains, private and
   special address ranges and the lengths of their parts stay; checksums hold. Names: made-up ones of the same script and gender.
3. Collision checks, on what is written and over all kinds: an entity whose surrogate is a real entity of the corpus, or was given to another one, takes its next attempt, up to
   ``ATTEMPTS``. Where a form is so crowded that this fails, the rest of its entities take each other's values, each the next one's in a keyed order: different entities still stay
   different and none keeps its own value, but those surrogates occur in the corpus as other entities. A form with one possible value keeps it.
4. Texts are rewritten where they are read. Only entities beyond their first attempt must be known for that. They are few and go to all tasks if there are at most ``broadcast_rows``; beyond
   that they are joined to the documents that mention them.

Names are found after a title (before it in Han script), by a given name of a short list before a capitalised word, after a phrase that introduces a name, and before an e-mail address in brackets;
each part that was found counts wherever else it stands in the document in the same spelling. A name that nothing of this kind announces is not found.

Defined cases: a null text stays null and an empty one empty; spans are code points of the text written; of overlapping entities the first kind in ``KINDS``
counts; repeated rows are each rewritten, alike; null ids are kept; a text of any length is scanned whole, in time that grows with its length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabgauge.llm.common import cut

#: In order of precedence.
KINDS = ("email", "iban", "card", "phone", "ipv4", "ssn", "given", "surname")
#: Tries for a surrogate that isn't taken, and entities of a crowded form that one task puts in order.
ATTEMPTS, CROWD = 12, 100_000

_EMAIL = re.compile(r"(?<![\w.+-])[\w](?:[\w.+-]*[\w+-])?@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w+.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w])")
_PHONE = re.compile(
    r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{1,5}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w])"  # (017) 555-7713
    r"|(?<![\w+.-])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,5}){2,5}(?![\w])"  # +49 30 1234567
    r"|(?<![\w+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w])"  # 555-123-4567
)
_IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])(?![A-Za-z_])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
#: Titles that say the gender of the name after them, and titles that don't.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "Г-жа", "Κυρία", "السيدة", "الآنسة")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Г-н", "Κύριος", "Κύριε", "السيد")
OTHER_TITLES = ("Dr", "Prof", "Доктор", "Δρ", "الدكتور", "الدكتورة")
#: Titles after a name in Han script.
HAN_TITLES = {"女士": "f", "小姐": "f", "先生": "m", "教授": "", "博士": ""}
#: Given names that are known without a title, if a capitalised word follows.
FEMALE_GIVEN = ("Mary", "Maria", "María", "Anna", "Emma", "Sarah", "Laura", "Julia", "Sophie", "Elena", "Claire", "Lucía", "Katharina", "Jennifer", "Elizabeth", "Patricia", "Мария", "Анна", "Елена", "Ольга")
MALE_GIVEN = ("John", "James", "Robert", "Michael", "David", "William", "Thomas", "Peter", "Pierre", "Hans", "Carlos", "José", "Pedro", "Stefan", "Jürgen", "Richard", "Иван", "Сергей", "Дмитрий", "Алексей")
#: What introduces a given name and a surname.
CUES = ("name is", "Name:", "From:", "To:", "Cc:", "Author:", "Contact:", "Signed:", "signed by", "Sincerely,", "Regards,", "Ich heiße", "Mein Name ist", "m'appelle", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "Меня зовут", "меня зовут", "Με λένε", "με λένε", "اسمي")
_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ][^\W\d_]+(?:[-’'][^\W\d_]+)?"
_MARKS = FEMALE_TITLES + MALE_TITLES + OTHER_TITLES + FEMALE_GIVEN + MALE_GIVEN
_NAME = re.compile(
    rf"\b(?P<title>{'|'.join(sorted(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES, key=len, reverse=True))})\.?[ ](?P<first>{_CAPITAL})(?:[ ](?P<last>{_CAPITAL}))?"
    rf"|\b(?P<given>{'|'.join(FEMALE_GIVEN + MALE_GIVEN)})[ ](?P<after>{_CAPITAL})")
_CUED = re.compile(rf"(?:{'|'.join(map(re.escape, CUES))})\s+(?P<one>{_CAPITAL})[ ](?P<two>{_CAPITAL})")
_MAILED = re.compile(rf"\b(?P<one>{_CAPITAL})[ ](?P<two>{_CAPITAL})[ ]?[<(](?=[\w.+-]+@)")
_HAN = re.compile(rf"(?P<two>[一-鿿])(?P<one>[一-鿿]{{1,2}}?)(?P<title>{'|'.join(HAN_TITLES)})")
_WORD = re.compile(_CAPITAL)
#: Syllables of made-up names by script; given names end by gender, surnames alike.
NAME_PARTS = {
    "latin": (("bel", "cor", "dan", "el", "fal", "gar", "hel", "jor", "kel", "lor", "mar", "nor", "per", "ros", "sel", "tor", "val", "wen"), {"f": ("ia", "ina", "elle", "a"), "m": ("in", "o", "us", "en"), "": ("is", "e", "y", "an")}, ("son", "mann", "ez", "ard", "ley", "er")),
    "cyrillic": (("бел", "вар", "гор", "дан", "ел", "зор", "кор", "лад", "мир", "нор", "рад", "сев", "тим", "яр"), {"f": ("а", "ия", "ина"), "m": ("ан", "ен", "ислав"), "": ("а", "ь")}, ("енко", "ко", "ук", "ич")),
    "greek": (("αλ", "βελ", "γαρ", "δαν", "ζαν", "θεο", "καρ", "λεον", "μαρ", "νικ", "παν", "σελ", "τιμ", "φιλ"), {"f": ("ία", "ίνα", "η"), "m": ("ος", "ης", "ων"), "": ("ις", "υ")}, ("ίδης", "άκης", "όπουλος")),
    "arabic": (("با", "دا", "را", "سا", "كا", "لا", "ما", "نا", "فا", "جا", "حا", "طا"), {"f": ("ية", "ينة"), "m": ("ين", "ود"), "": ("ان", "ام")}, ("اوي", "اني", "ري")),
    "han": (tuple("云山石林江河海川木青田平安文明光远清和松"), {"f": tuple("兰梅莲英"), "m": tuple("刚强军峰"), "": tuple("新正")}, tuple("丘古白方")),
}
#: Letters that stand for one another; other letters stand for those of their case among 64 neighbouring code points.
ALPHABETS = ("0123456789", *(x for low in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω") for x in (low, low.upper())))


def _luhn(digits: str) -> int:
    """0 if the last digit is the checksum of those before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _iban_checked(plain: str) -> bool:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


Span = tuple[int, int, str, str]


def _beside(taken: list[Span], more: list[Span]) -> list[Span]:
    """Both lists, in order, without those of ``more`` that overlap one of ``taken``; each is in order and free of overlaps."""
    out, i = [], 0
    for x in more:
        while i < len(taken) and taken[i][1] <= x[0]:
            out.append(taken[i])
            i += 1
        if i == len(taken) or x[1] <= taken[i][0]:
            out.append(x)
    return out + taken[i:]


class Finder:
    """Entities of a text: (start, end, kind, normal form), in order, without overlaps."""

    def __call__(self, text: str) -> list[Span]:
        taken: list[Span] = []

        def add(kind: str, pattern: re.Pattern, normal, right=None) -> None:
            nonlocal taken
            found = [(m.start(), m.end(), kind, normal(m[0])) for m in pattern.finditer(text)]
            taken = _beside(taken, [x for x in found if right is None or right(x[3])])

        if "@" in text:
            add("email", _EMAIL, str.lower)
        if re.search(r"[0-9]{2}|[0-9]\.", text):
            add("iban", _IBAN, lambda x: x.replace(" ", ""), _iban_checked)
            add("card", _CARD, lambda x: re.sub(r"\D", "", x), lambda x: _luhn(x) == 0)
            add("phone", _PHONE, lambda x: re.sub(r"[^0-9+]", "", x))
            add("ipv4", _IPV4, str)
            add("ssn", _SSN, lambda x: x.replace("-", ""))
        names = self.names(text)
        return _beside(taken, names) if names else taken

    @staticmethod
    def names(text: str) -> list[Span]:
        """Parts of names, given names with their gender."""
        found: list[Span] = []

        def pair(m: re.Match, first: str, last: str, gender: str) -> None:
            gender = gender or ("f" if m[first] in FEMALE_GIVEN else "m" if m[first] in MALE_GIVEN else "")
            found.append((*m.span(first), "given", f"{gender}:{m[first].casefold()}"))
            found.append((*m.span(last), "surname", m[last].casefold()))

        if any(x in text for x in _MARKS):
            for m in _NAME.finditer(text):
                title, given = m["title"], m["given"]
                if title and not m["last"]:  # a title and one name: the surname
                    found.append((*m.span("first"), "surname", m["first"].casefold()))
                else:
                    pair(m, *(("first", "last") if title else ("given", "after")), "f" if title in FEMALE_TITLES or given in FEMALE_GIVEN else "m" if title in MALE_TITLES or given in MALE_GIVEN else "")
        if any(x in text for x in CUES):
            for m in _CUED.finditer(text):
                pair(m, "one", "two", "")
        if "@" in text:
            for m in _MAILED.finditer(text):
                pair(m, "one", "two", "")
        if any(x in text for x in HAN_TITLES):
            for m in _HAN.finditer(text):
                pair(m, "one", "two", HAN_TITLES[m["title"]])
        if not found:
            return []
        found.sort(key=lambda x: x[:2])
        # what was found, once for each place, and bare mentions of it elsewhere
        held: list[Span] = []
        for x in found:
            if not held or held[-1][1] <= x[0]:
                held.append(x)
        of: dict[str, tuple[str, str]] = {}
        for a, b, kind, entity in held:  # a word that is known as both is a surname there, and a gender that is known once counts
            word = text[a:b]
            if kind == "surname" or word not in of or of[word][1].startswith(":"):
                of[word] = (kind, entity)
        held = [(a, b, *(of[text[a:b]] if kind == "given" and of[text[a:b]][0] == "given" else (kind, entity))) for a, b, kind, entity in held]
        held = _beside(held, [(m.start(), m.end(), *of[m[0]]) for m in _WORD.finditer(text) if m[0] in of])
        han = sorted({text[a:b] + text[c:d] for (a, b, k, _), (c, d, l, _) in zip(held, held[1:]) if b == c and (k, l) == ("surname", "given")})
        if han:  # whole names without a title
            parts = {text[a:d]: (b - a, e, f) for (a, b, k, e), (c, d, l, f) in zip(held, held[1:]) if b == c and (k, l) == ("surname", "given")}
            more = [x for m in re.finditer("|".join(map(re.escape, han)), text) for n, e, f in [parts[m[0]]] for x in ((m.start(), m.start() + n, "surname", e), (m.start() + n, m.end(), "given", f))]
            held = _beside(held, more)
        return held


class Stream:
    """Numbers from a key and a message, without end."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.message, self.block, self.pool = key, "\0".join(parts).encode("utf-8", "replace"), 0, []

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            digest = hmac.new(self.key, self.message + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block, self.pool = self.block + 1, [*self.pool, *digest]
        x = int.from_bytes(bytes(self.pool[:4]), "big")
        del self.pool[:4]
        return x * n >> 32


def permute(key: bytes, tweak: str, x: int, n: int) -> int:
    """The place of x in a keyed permutation of the numbers below n."""
    if n < 2:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask, size = (1 << half) - 1, half // 8 + 1
    while True:  # a Feistel network permutes the numbers of an even count of bits; those beyond n are walked through
        left, right = x >> half, x & mask
        for i in range(8):
            message = f"{tweak}\0{i}\0".encode("utf-8", "replace") + right.to_bytes(size, "big")
            noise = b"".join(hmac.digest(key, message + bytes([k]), "sha256") for k in range(size // 32 + 1))
            left, right = right, left ^ int.from_bytes(noise, "big") & mask
        x = left << half | right
        if x < n:
            return x


def _permuted(key: bytes, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
    """Digits of mixed radices, permuted as one number."""
    x, n = 0, 1
    for d, r in zip(digits, radices):
        x, n = x * r + d, n * r
    x, out = permute(key, tweak, x, n), []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


@lru_cache(4096)
def alphabet(c: str) -> str:
    """The characters that may stand for c; of marks, c alone."""
    if not c.isalpha() and not "0" <= c <= "9":
        return c
    own = next((a for a in ALPHABETS if c in a), None)
    if own:
        return own
    start = ord(c) & ~63
    return "".join(x for x in map(chr, range(start, start + 64)) if x.isalpha() and unicodedata.category(x) == unicodedata.category(c) and not any(x in a for a in ALPHABETS))


def form(text: str) -> str:
    """Equal for texts whose characters stand for one another."""
    return "".join(alphabet(c)[0] for c in text)


def like(key: bytes, tweak: str, text: str) -> str:
    """A text of the same form, by a keyed permutation of all such texts."""
    sets = [alphabet(c) for c in text]
    got = _permuted(key, f"{tweak}\0{form(text)}", [a.index(c) for a, c in zip(sets, text)], [len(a) for a in sets])
    return "".join(a[i] for a, i in zip(sets, got))


def script_of(name: str) -> str:
    for c in name:
        for script, start, end in (("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("arabic", 0x600, 0x6FF), ("han", 0x4E00, 0x9FFF)):
            if start <= ord(c) <= end:
                return script
        if c.isalpha() and ord(c) > 0x24F:
            return "other"
    return "latin"


def network(octets: list[int]) -> str:
    """The range of an IPv4 address: public, or a name for each private or special one."""
    a, b = octets[:2]
    if a in (0, 10, 127):
        return str(a)
    if a == 172 and 16 <= b < 32:
        return "172.16"
    if a == 100 and 64 <= b < 128:
        return "100.64"
    if (a, b) in ((192, 168), (169, 254)):
        return f"{a}.{b}"
    return "public" if a < 224 else "multicast" if a < 240 else "reserved"


def _octets(entity: str) -> tuple[list[int], list[tuple[int, int]]]:
    """The octets, and for each the lowest value and the number of values that may stand for it."""
    octets = [int(o) for o in entity.split(".")]
    ranges = [((0, 10), (10, 90), (100, 156))[len(str(o)) - 1] for o in octets]
    own = network(octets)
    if own in ("172.16", "100.64"):
        low, high = {"172.16": (16, 32), "100.64": (64, 128)}[own]
        start, size = ranges[1]
        ranges[1] = (max(low, start), min(high, start + size) - max(low, start))
    for i in range({"public": 0, "multicast": 0, "reserved": 0, "192.168": 2, "169.254": 2}.get(own, 1)):
        ranges[i] = (octets[i], 1)
    return octets, ranges


_CODE = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")


def form_of(kind: str, entity: str) -> str:
    """What a surrogate keeps: entities of one form are permuted among its values."""
    if kind == "email":
        return f"email {form(entity.rpartition('.')[0])}.{entity.rpartition('.')[2]}"
    if kind == "iban":
        return f"iban {entity[:2]} {form(entity[4:])}"
    if kind == "card":
        return f"card {entity[0]} {len(entity)}"
    if kind == "phone":
        code = _CODE.match(entity)
        return f"phone {code[0] if code else ''} {len(entity)}"
    if kind == "ipv4":
        octets, ranges = _octets(entity)
        return f"ipv4 {network(octets)} {ranges}"
    if kind == "ssn":
        return "ssn"
    gender, _, name = entity.rpartition(":") if kind == "given" else ("", "", entity)
    return f"{kind} {gender} {script_of(name)}"


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The surrogate's normal form for the ``attempt``-th try. Names get longer with it; others are permuted anew."""
    tweak = f"{kind}\0{attempt}"
    if kind == "email":
        local, _, domain = entity.partition("@")
        head, dot, top = domain.rpartition(".")
        return like(key, tweak, local) + "@" + like(key, f"domain\0{max(0, attempt - 4)}", head) + dot + top  # one domain has one surrogate
    if kind == "iban":
        body = like(key, f"{tweak}\0{entity[:2]}", entity[4:])
        return f"{entity[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + entity[:2] + '00')) % 97:02d}{body}"
    if kind == "card":
        body = entity[0] + like(key, tweak + entity[0], entity[1:-1])
        return body + next(d for d in "0123456789" if _luhn(body + d) == 0)
    if kind == "phone":  # the country code stays
        code = _CODE.match(entity)
        head = code[0] if code else ""
        return head + like(key, f"{tweak}\0{head}", entity[len(head):])
    if kind == "ipv4":  # private and special ranges stay, and public addresses stay public
        octets, ranges = _octets(entity)
        own, tweak = network(octets), f"{tweak}\0{form_of(kind, entity)}"
        while True:
            octets = [low + d for (low, _), d in zip(ranges, _permuted(key, tweak, [o - low for o, (low, _) in zip(octets, ranges)], [n for _, n in ranges]))]
            if network(octets) == own:
                return ".".join(map(str, octets))
    if kind == "ssn":
        area, group, serial = int(entity[:3]), int(entity[3:5]), int(entity[5:])
        a, g, s = _permuted(key, tweak, [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999])
        return f"{a + 1 + (a >= 665):03d}{g + 1:02d}{s + 1:04d}"
    s = Stream(key, kind, entity, str(attempt))
    gender, _, name = entity.rpartition(":") if kind == "given" else ("", "", entity)
    script = script_of(name)
    if script == "other":
        letters = [c for c in name if c.isalpha()]
        made = "".join(alphabet(c)[s.below(len(alphabet(c)))] for c in letters + letters[:1] * attempt)
    else:
        parts, given_ends, family_ends = NAME_PARTS[script]
        ends = given_ends[gender] if kind == "given" else family_ends
        few = 1 if script == "han" else 2 + s.below(2)
        made = "".join(parts[s.below(len(parts))] for _ in range(few + attempt)) + ends[s.below(len(ends))]
    return f"{gender}:{made}" if kind == "given" else made


def render(kind: str, seen: str, made: str) -> str:
    """``made``, a surrogate's normal form, in the layout and case of ``seen``."""
    if kind == "email":
        return made.upper() if seen.isupper() else made
    if kind in ("iban", "card", "phone", "ssn"):
        rest = iter(made)
        out = "".join(next(rest, "") if c.isalnum() or c == "+" else c for c in seen)
        return out + "".join(rest)
    if kind == "ipv4":
        return made
    name = made.rpartition(":")[2]
    return name.upper() if seen.isupper() and seen.lower() != seen and len(seen) > 1 else name.capitalize()


def written(kind: str, normal: str) -> str:
    """What collisions are checked on: the normal form without a gender."""
    return normal.rpartition(":")[2] if kind == "given" else normal


def _entities(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct (kind, entity) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for batch in batches:
            seen = {(kind, entity) for text in batch.column(0) if text.is_valid for _, _, kind, entity in find(text.as_py())}
            if seen:
                kinds, entities = zip(*sorted(seen))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(entities, pa.string())], names=["kind", "entity"])

    return docs.select(text_col).mapInArrow(run, "kind string, entity string").distinct()


def assign(entities: DataFrame, key: bytes, attempts: int = ATTEMPTS, crowd: int = CROWD) -> DataFrame:
    """(kind, entity, made) of the entities that can't keep the surrogate of attempt 0. entities: distinct and materialised."""

    def tries(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind, entity, attempt = (batch.column(c).to_pylist() for c in ("kind", "entity", "attempt"))
                made = [surrogate(key, k, e, a) for k, e, a in zip(kind, entity, attempt)]
                text = lambda values: pa.array(values, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("kind", "entity", "attempt")), text(made), text([written(k, m) for k, m in zip(kind, made)]), text([form_of(k, e) for k, e in zip(kind, entity)])],
                    names=["kind", "entity", "attempt", "made", "written", "form"])

        return rows.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, made string, written string, form string")

    # as in written()
    real = entities.select(F.when(F.col("kind") == "given", F.substring_index("entity", ":", -1)).otherwise(F.col("entity")).alias("written")).distinct()
    settled = None
    tried = cut(tries(entities.withColumn("attempt", F.lit(0))))
    for n in range(attempts):
        # Who settled first wins a surrogate, then the least entity; a real entity of the corpus wins over all.
        pool = tried.withColumn("late", F.lit(1))
        if settled is not None:
            pool = pool.unionByName(settled.withColumn("late", F.lit(0)))
        first = pool.groupBy("written").agg(F.min(F.struct("late", "kind", "entity")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        clash = tried.join(first, "written").where((F.col("first.kind") != F.col("kind")) | (F.col("first.entity") != F.col("entity")))
        lost = cut(clash.select(*tried.columns).union(tried.join(real, "written", "left_semi").select(*tried.columns)).distinct())
        if lost.isEmpty():
            break
        won = tried.join(lost, ["kind", "entity"], "left_anti")
        settled = cut(won if settled is None else settled.unionByName(won))
        if n + 1 == attempts:
            settled, tried = settled.unionByName(_rotated(lost, entities, tries, crowd)), lost.limit(0)
        else:
            tried = cut(tries(lost.withColumn("attempt", F.col("attempt") + 1)))
    everything = tried if settled is None else settled.unionByName(tried)
    return everything.where("attempt > 0").select("kind", "entity", "made")


def _rotated(lost: DataFrame, entities: DataFrame, tries, crowd: int) -> DataFrame:
    """Entities that found no free surrogate: each takes the value of the next one of its form, in a keyed order; one that is alone that of another entity of its form."""
    counts = cut(lost.groupBy("form").agg(F.count(F.lit(1)).alias("n")))
    order = F.xxhash64("made", "entity")
    parts = F.pmod(F.xxhash64("entity", "made"), F.ceil(F.col("n") / crowd)).alias("part")  # about ``crowd`` or more in each, so none is alone
    dealt = lost.join(counts, "form").select(*lost.columns, "n", parts)
    ring = Window.partitionBy("form", "part")
    place = ring.orderBy(order, "entity")
    ahead = F.coalesce(F.lead("entity").over(place), F.first("entity").over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    many = dealt.where("n > 1").withColumn("made", ahead)
    lone = cut(dealt.where("n = 1"))
    if lone.isEmpty():
        found = many
    else:
        others = tries(entities.withColumn("attempt", F.lit(0))).select("form", F.col("entity").alias("other"))
        least = others.join(lone.select("form", "entity"), "form").where(F.col("other") != F.col("entity")).groupBy("form").agg(F.min("other").alias("other"))
        found = many.unionByName(lone.join(least, "form", "left").withColumn("made", F.coalesce("other", "entity")).drop("other").select(many.columns))
    return cut(found.withColumn("attempt", F.lit(1 << 20)).withColumn("written", F.col("made")).select(lost.columns))


def rewrite(text: str, key: bytes, late: dict[tuple[str, str], str], find: Finder) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and their spans in it. ``late`` has the surrogates beyond the first attempt."""
    out, spans, at, length = [], [], 0, 0
    for a, b, kind, entity in find(text):
        put = render(kind, text[a:b], late.get((kind, entity)) or _first_attempt(key, kind, entity))
        out += [text[at:a], put]
        length += a - at
        spans.append((length, length + len(put), kind))
        length, at = length + len(put), b
    return "".join([*out, text[at:]]), spans


@lru_cache(1 << 14)
def _first_attempt(key: bytes, kind: str, entity: str) -> str:
    return surrogate(key, kind, entity)


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """One row per document: ``id_col``, ``text_col`` with surrogates, and entities, an array of (start, end, kind) in the new text."""
    late = cut(assign(cut(_entities(docs, text_col)), key))
    source = docs.select(id_col, text_col)
    id_type = source.schema[0].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    schema = f"`{id_col}` {id_type}, `{text_col}` string, entities array<struct<start:bigint,end:bigint,kind:string>>"
    few = late.limit(broadcast_rows + 1).count() <= broadcast_rows
    known = {(r.kind, r.entity): r.made for r in late.collect()} if few else {}
    if not few:
        source = _with_late(source, late, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for batch in batches:
            texts, found = [], []
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for text, extra in zip(batch.column(1), own):
                if not text.is_valid:
                    texts.append(None)
                    found.append([])
                    continue
                made, at = rewrite(text.as_py(), key, {(x["kind"], x["entity"]): x["made"] for x in extra} if extra else known, find)
                texts.append(made)
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, spans)], names=[id_col, text_col, "entities"])

    return source.mapInArrow(run, schema)


def _with_late(source: DataFrame, late: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``source`` with the late surrogates of each text's own entities, joined by the text's hash."""
    keyed = source.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"), F.sha2(text_col, 256).alias("own_key"))

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for batch in batches:
            rows = [(k, kind, entity) for k, text in zip(batch.column(0).to_pylist(), batch.column(1)) if text.is_valid for kind, entity in {x[2:] for x in find(text.as_py())}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["own_key", "kind", "entity"])

    said = keyed.select("own_key", "own_text").mapInArrow(mentions, "own_key string, kind string, entity string").distinct()
    own = said.join(late, ["kind", "entity"]).groupBy("own_key").agg(F.collect_list(F.struct("kind", "entity", "made")).alias("late"))
    return keyed.join(own, "own_key", "left").select(F.col("own_id").alias(id_col), F.col("own_text").alias(text_col), "late")
