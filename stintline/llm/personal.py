"""Personal data: detection by patterns and names, keyed surrogates of equal type, gender, script and format.

A surrogate is a keyed bijection without fixed points on all values of the same shape, so equal values get equal
surrogates in every document and different values different ones, without a table that every task must hold. Spark
proves it all the same: pairs are grouped by surrogate.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import drop, lean, parts, save

#: The key of the surrogates; set it for real data, since the default is public.
KEY = os.environ.get("PII_SURROGATE_KEY", "public key for tests")

# --- alphabets and names ---------------------------------------------------


def _span(a: str, b: str) -> str:
    return "".join(map(chr, range(ord(a), ord(b) + 1)))


#: A character is replaced by another of its own alphabet; characters of none stay.
ALPHABETS = [
    "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüýœ", "çñčšžćđłńśźż", "0123456789",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ьъ", "іїєґўј", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
    _span("א", "ת"), _span("ء", "غ") + _span("ف", "ي"), _span("अ", "ह"), _span("ก", "ฮ"), _span("ぁ", "ゖ"), _span("ァ", "ヺ"), _span("가", "힣"), _span("一", "龥"),
]


def _others() -> list[str]:
    """Letters and digits of all further scripts, by the first word of their names, 256 code points and category."""
    taken, out = set("".join(ALPHABETS)), {}
    for c in map(chr, range(0xAA, 0x10000)):
        sort = unicodedata.category(c)
        if sort in ("Ll", "Lo", "Nd") and c not in taken and len(c.upper()) == 1 and c.upper().lower() == c:
            out.setdefault((unicodedata.name(c, "").split(" ")[0].split("-")[0], ord(c) >> 8, sort), []).append(c)
    return ["".join(x) for x in out.values() if len(x) > 1]


ALPHABETS += _others()
_ALPHABET = {c: (i, k) for i, a in enumerate(ALPHABETS) for k, c in enumerate(a)}

#: Given names by script and gender.
GIVEN = {
    "latin f": "Mary Anna Emma Laura Sarah Julia Maria Elizabeth Linda Barbara Susan Jessica Karen Nancy Margaret Sandra Ashley Emily Michelle Amanda Stephanie Rebecca Katharina Sabine Ursula Monika Petra Claudia Heike Greta Ingrid Marie Camille Sophie Chloé Élodie Nathalie Isabelle Catherine Françoise Carmen Lucía Dolores Pilar Teresa Mercedes Sofía Elena Paula Cristina",
    "latin m": "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Donald Steven Andrew Kenneth George Edward Brian Hans Klaus Jürgen Wolfgang Stefan Uwe Dieter Heinz Günter Jean Pierre Michel Philippe François Nicolas Laurent Guillaume Étienne Antoine José Juan Carlos Javier Miguel Alejandro Francisco Pablo Diego Fernando",
    "cyrillic f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Людмила Галина Дарья Полина",
    "cyrillic m": "Иван Александр Сергей Дмитрий Алексей Андрей Михаил Николай Владимир Павел Максим Евгений Олег Юрий",
    "greek f": "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα",
    "greek m": "Γιώργος Δημήτρης Κώστας Γιάννης Νίκος Παναγιώτης Βασίλης Χρήστος",
}
_POOLS = {k: [x.lower() for x in v.split()] for k, v in GIVEN.items()}
_GIVEN = {x: (k, i) for k, v in _POOLS.items() for i, x in enumerate(v)}
TITLES = set("mr mrs ms miss mister dr prof professor herr frau monsieur madame mademoiselle mme mlle señor señora señorita sr sra srta don doña господин госпожа κύριος κυρία".split())
_UPPER = "A-ZÀ-ÖØ-ÞŒČŠŽĆĐŁŚŹŻА-ЯЁІЇЄҐΑ-ΩΆΈΉΊΌΎΏ"
_CAP = rf"[{_UPPER}][^\W\d_]*(?:['’-][^\W\d_]+)*"
_PART = r"(?:(?:von|van|der|den|de|del|della|di|da|du|la|le|los|las|zu|y|bin|al)[  ]+)"
#: Runs of capitalised words; which of them hold a name is for `_names` to say.
_RUN = re.compile(rf"{_CAP}(?:(?:(?<=[^\W\d_])|(?<=\b[^\W\d_]{{1}}\.)|(?<=\b[^\W\d_]{{2}}\.)|(?<=\b[^\W\d_]{{3}}\.)|(?<=\b[^\W\d_]{{4}}\.))\.?[  ]+{_PART}{{0,3}}{_CAP})*")
_LOW_TITLE = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[  ]+{_PART}{{0,3}}$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Endings that tell a gender stay.
_ENDING = re.compile(r"(?:ская|цкая|ский|цкий|ова|ева|ёва|ина|ына|ов|ев|ёв|ин|ын|ska|ská|ski|ský|ová|ova|eva)$")

_FREE = "(?<![0-9A-Za-z_.+-])"
_PATTERNS = {
    "email": r"(?<![^\W_])[^\W_](?:[\w.+%'-]{0,62}[\w+%'-])?@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![^\W_])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]){11,30}(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])",
    "ipv4": rf"{_FREE}(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9A-Za-z_]|\.[0-9])",
    "card": rf"{_FREE}[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9A-Za-z_]|[.-][0-9])",
    "ssn": rf"{_FREE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z_]|[.-][0-9])",
    "phone": r"(?<![0-9A-Za-z_.+])(?:(?:\+|00)[1-9](?:[ ./-]{0,2}\(?[0-9]\)?){6,14}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3})(?![0-9A-Za-z_]|[.-][0-9])",
}
_ONE = {k: re.compile(v) for k, v in _PATTERNS.items()}
#: What a text must hold before a pattern that begins with letters is tried on it, and where the others may begin.
_GATE = {"email": re.compile("@"), "iban": re.compile("[A-Z]{2}[0-9]{2}"), "ipv6": re.compile("[0-9A-Fa-f]:[0-9A-Fa-f:]")}
_NUMBERS = [(k, v) for k, v in _ONE.items() if k not in _GATE]
_BEGIN = re.compile("[0-9+(]")

# --- keyed bijections ------------------------------------------------------


#: Places of a value that are moved as one number.
BLOCK = 256


class Cipher:
    """Keyed bijections of 0..n-1, one for each label, that move every number (n > 1)."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _number(self, *what) -> int:
        return int.from_bytes(hashlib.blake2b(repr(what).encode(), key=self.key, digest_size=64).digest(), "big")

    def _wide(self, below: int, *what) -> int:
        out, blocks = 0, below.bit_length() // 512 + 2
        for i in range(blocks):
            out = out << 512 | self._number(i, *what)
        return out % below

    def _mixed(self, x: int, n: int, label: str, back: bool) -> int:
        side = math.isqrt(n - 1) + 1
        while True:
            a, b = divmod(x, side)
            for r in range(7, -1, -1) if back else range(8):
                step = self._wide(side, label, n, r, b if r % 2 else a)
                step = -step if back else step
                a, b = ((a + step) % side, b) if r % 2 else (a, (b + step) % side)
            x = a * side + b
            if x < n:
                return x

    def move(self, x: int, n: int, label: str) -> int:
        """One cycle through all n numbers: a shift by a keyed step without common factor, between a mixing and its inverse."""
        if n < 2:
            return x
        step, k = 0, 0
        while math.gcd(step, n) != 1:
            step, k = self._wide(n, "step", label, n, k) or 1, k + 1
        return self._mixed((self._mixed(x, n, label, False) + step) % n, n, label, True)

    def text(self, value: str, label: str, good: Callable[[str], bool] = lambda x: True) -> str:
        """Another text of the same alphabets place by place, in lower case as `value`; on along the cycle until `good`.

        A long value is moved in blocks, each under a label that tells what stood before it, so that all of it is one
        bijection and the time is in proportion to its length.
        """
        places = [_ALPHABET.get(c) for c in value]
        shape = "".join(c if p is None else chr(0xE000 + p[0]) for c, p in zip(value, places, strict=True))
        sizes, numbers = [len(ALPHABETS[p[0]]) for p in places if p], [p[1] for p in places if p]
        if len(numbers) > BLOCK:
            shape = hashlib.blake2b(shape.encode("utf-8", "surrogatepass")).hexdigest()
        while True:
            moved, before = [], hashlib.blake2b()
            for low in range(0, len(numbers), BLOCK):
                own, size = numbers[low : low + BLOCK], sizes[low : low + BLOCK]
                x = 0
                for k, n in zip(own, size, strict=True):
                    x = x * n + k
                rest = self.move(x, math.prod(size), f"{label} {shape}" if len(numbers) <= BLOCK else f"{label} {shape} {low} {before.hexdigest()}")
                before.update(bytes(k % 256 for k in own))
                digits = []
                for n in reversed(size):
                    rest, k = divmod(rest, n)
                    digits.append(k)
                moved += reversed(digits)
            numbers, it = moved, iter(moved)
            found = "".join(c if p is None else ALPHABETS[p[0]][next(it)] for c, p in zip(value, places, strict=True))
            if good(found) or found == value:
                return found


def _cased(new: str, like: str) -> str:
    if len(like) > 1 and like.isupper():
        return new.upper()
    if len(new) == len(like):
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, like, strict=True))
    return new.title() if like[:1].isupper() else new


def _fill(digits: str, like: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


def luhn(digits: str) -> int:
    """The check sum of a card number, 0 if it is valid."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


#: Domains that name no person: they stay, the rest of the address does not.
SHARED = {"example.com", "example.org", "example.net", "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "gmx.de", "web.de", "orange.fr", "mail.ru"}
_SECOND = {"co", "com", "org", "net", "ac", "gov", "edu"}


class Surrogates:
    """Canonical value and surrogate of each kind. Equal canonical values are one person's datum, however written."""

    def __init__(self, key: str):
        self.cipher = Cipher(key)
        self.word = lru_cache(100_000)(self._word)
        self.of = lru_cache(100_000)(lambda kind, v: getattr(self, kind)(v))

    def email(self, v: str) -> tuple[str, str]:
        low = v.lower()
        if len(low) != len(v):
            return low, self.email(low)[1]
        local, domain = low.rsplit("@", 1)
        labels = domain.split(".")

        def shared(labels: list[str]) -> int:
            return next((i for i in range(len(labels) - 1) if ".".join(labels[i:]) in SHARED), -1)

        own = shared(labels)
        if own < 0:
            own = len(labels) - (2 if len(labels) > 2 and labels[-2] in _SECOND and len(labels[-1]) == 2 else 1)
        tail = ".".join(labels[own:])
        head = "@".join([local, ".".join(labels[:own])])
        kept = shared(labels) >= 0

        def good(x: str) -> bool:
            got = f"{x}.{tail}".rsplit("@", 1)[1].lstrip(".").split(".")
            second = len(got) > 2 and got[-2] in _SECOND and len(got[-1]) == 2
            return kept or (shared(got) < 0 and second == (tail.count(".") == 1))

        new = self.cipher.text(head, f"email {tail}", good)
        return low, _cased(new + ("" if head.endswith("@") else ".") + tail, v)

    def iban(self, v: str) -> tuple[str, str]:
        plain = v.replace(" ", "")
        body = self.cipher.text(plain[4:].lower(), f"iban {plain[:2]}").upper()
        number = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        it = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00'):02d}" + body)
        return plain, "".join(c if c == " " else next(it) for c in v)

    def ipv4(self, v: str) -> tuple[str, str]:
        x = 0
        for o in v.split("."):
            x = x << 8 | int(o)
        nets = [(0x0A000000, 24), (0x7F000000, 24), (0, 24), (0xAC100000, 20), (0xC0A80000, 16), (0xA9FE0000, 16), (0xE0000000, 29)]
        sort = lambda y: next(((a, b) for a, b in nets if y >> b == a >> b), (0, 32))
        base, bits = sort(x)
        while True:
            x = base + self.cipher.move(x - base, 1 << bits, f"ipv4 {base}")
            if sort(x) == (base, bits):
                return v, ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))

    def ipv6(self, v: str) -> tuple[str, str]:
        import ipaddress

        x = int(ipaddress.IPv6Address(v))
        top = x >> 112
        new = ipaddress.IPv6Address(top << 112 | self.cipher.move(x & ((1 << 112) - 1), 1 << 112, f"ipv6 {top}"))
        return str(ipaddress.IPv6Address(x)), str(new).upper() if v.isupper() else str(new)

    def card(self, v: str) -> tuple[str, str]:
        d = re.sub(r"\D", "", v)
        body = d[0] + self.cipher.text(d[1:-1], f"card {d[0]} {luhn(d)}")
        # the check digit is as right or as wrong as it was
        last = (luhn(d) - luhn(body + "0")) % 10
        return d, _fill(body + str(last), v)

    def ssn(self, v: str) -> tuple[str, str]:
        d = v.replace("-", "")
        return d, _fill(self.cipher.text(d, "ssn"), v)

    def phone(self, v: str) -> tuple[str, str]:
        """The country's number stays, and the exchange 555 that is given to nobody; an area goes on with 2-9 if it did."""
        d = re.sub(r"\D", "", v)
        if v[:1] == "+" or v[:2] == "00":
            d = d.removeprefix("00") if v[0] != "+" else d
            code = d[:1] if d[0] in "17" else d[:2]
            rest, plus = d[len(code) :], "+"
        else:
            code, rest, plus = ("0", d[1:], "") if d[0] == "0" and len(d) != 10 else ("", d, "")
        if code in ("1", "") and len(rest) == 10:
            fixed = rest[3:6] == "555"
            free = rest[:3] + rest[6:] if fixed else rest
            good = lambda x: (x[0] > "1") == (rest[0] > "1") and (fixed or x[3:6] != "555")
            new = self.cipher.text(free, f"phone {plus}{code} {fixed}", good)
            new = new[:3] + "555" + new[3:] if fixed else new
        else:
            new = self.cipher.text(rest, f"phone {plus}{code}", lambda x: (x[0] != "0") == (rest[0] != "0"))
        lead = "00" if v[:2] == "00" else ""
        return f"{plus}{code}{rest}", _fill(lead + code + new, v)

    def _word(self, w: str) -> str:
        low = w.lower()
        if low in _GIVEN:
            pool, i = _GIVEN[low]
            new = _POOLS[pool][self.cipher.move(i, len(_POOLS[pool]), pool)]
            return new.upper() if len(w) > 1 and w.isupper() else new.title()
        end = _ENDING.search(low)
        stem = low[: end.start()] if end and end.start() > 1 else low
        tail = low[len(stem) :]

        def good(x: str) -> bool:
            e = _ENDING.search(x + tail)
            return x + tail not in _GIVEN and x not in TITLES and (x + tail)[e.start() if e and e.start() > 1 else len(x + tail) :] == tail

        return _cased(self.cipher.text(stem, f"name {tail}", good) + tail, w)

    def name(self, v: str) -> tuple[str, str]:
        return v.lower(), self.word(v)


# --- detection -------------------------------------------------------------


def _is_kind(kind: str, v: str) -> bool:
    if kind == "card":
        d = re.sub(r"\D", "", v)
        return len(d) == 16 or luhn(d) == 0
    if kind == "iban":
        plain = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "ipv6":
        import ipaddress

        try:
            ipaddress.IPv6Address(v)
        except ValueError:
            return False
        return "::" in v and len(v) > 4 or v.count(":") == 7
    return kind != "phone" or 7 <= sum(c.isdigit() for c in v) <= 17


def _names(text: str) -> list[tuple[int, int]]:
    """Words of names: those after a title, those from a known given name on, and the same words where they stand alone."""
    spans, seen = [], set()
    for run in _RUN.finditer(text):
        a, b = run.span()
        if a and text[a - 1].isalnum():
            continue
        begin = 0 if a and text[a - 1] in "  " and _LOW_TITLE.search(text[max(0, a - 32) : a]) else None
        if begin is None and " " not in run.group() and " " not in run.group():
            continue
        words = [m.span() for m in _WORD.finditer(text, a, b)]
        if begin is None:
            for i, (a, b) in enumerate(words[:-1]):
                w = text[a:b].lower()
                if w in TITLES or (w in _GIVEN and text[a].isupper()):
                    begin = i + (w in TITLES)
                    break
        if begin is not None:
            own = [(a, b) for a, b in words[begin:] if text[a].isupper() and text[a:b].lower() not in TITLES]
            spans += own
            seen |= {text[a:b].lower() for a, b in own if b - a > 2}
    if seen:
        spans += [m.span() for m in _WORD.finditer(text) if text[m.start()].isupper() and m.group().lower() in seen]
    return sorted(set(spans))


def found(text: str) -> list[tuple[int, int, str]]:
    """(first character, end, kind) of the personal data of a text, in order and apart; of two that overlap the earlier kind's."""
    out: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in out)

    for kind, gate in _GATE.items():
        if gate.search(text):
            new = [(*m.span(), kind) for m in _ONE[kind].finditer(text) if _is_kind(kind, m.group())]
            out += [x for x in new if free(*x[:2])] if out else new
    taken = sorted(out)
    at, k, new = 0, 0, []
    for m in _BEGIN.finditer(text):
        a = m.start()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a < at or k < len(taken) and taken[k][0] <= a:
            continue
        for kind, pattern in _NUMBERS:
            n = pattern.match(text, a)
            if n and _is_kind(kind, n.group()) and (k == len(taken) or n.end() <= taken[k][0]):
                new.append((a, n.end(), kind))
                at = n.end()
                break
    taken, k, names = sorted(taken + new), 0, []
    for a, b in _names(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            names.append((a, b, "name"))
    return sorted(taken + names)


def _texts(column: pa.Array):
    """(first row, texts) of parts of a column of bounded size, nulls as None."""
    for row, end, data, offsets in parts(column):
        raw = data.tobytes()
        null = column.slice(row, end - row).is_null().to_pylist()
        yield row, end, [None if null[i] else raw[offsets[i] : offsets[i + 1]].decode() for i in range(end - row)]


def pairs(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate): each canonical value found in `docs`, once, with its surrogate in canonical form."""

    def run(batches):
        own = Surrogates(key)
        for batch in batches:
            for _, _, texts in _texts(batch.column(0)):
                seen = set()
                for t in texts:
                    for a, b, kind in found(t) if t else ():
                        value, new = own.of(kind, t[a:b])
                        seen.add((kind, value, own.of(kind, new)[0]))
                rows = sorted(seen)
                yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "value", "surrogate"])

    return docs.select("text").where("text is not null").mapInArrow(lean(run), "kind string, value string, surrogate string").distinct()


def clashes(of: DataFrame) -> DataFrame:
    """The pairs whose surrogate another value has too, or that are their own surrogate."""
    shared = of.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return of.join(shared, ["kind", "surrogate"], "left_semi").unionByName(of.where("value = surrogate"))


def replace(docs: DataFrame, key: str = KEY, check: bool = True) -> DataFrame:
    """`docs` with the personal data of `text` replaced by surrogates, and n_replaced.

    Found are e-mail addresses, IP addresses, card and account numbers, US social security numbers, phone numbers, and
    names that follow a title or begin with a known given name (their words also where they stand alone in the
    document). A value has one surrogate in all documents, in the writing of the place: letters stay letters of
    their script and case, given names of their gender, digits digits, check digits as right as they were. Null texts stay null.
    Repeated rows each give a row. `check` proves over all documents that no two values share a surrogate.
    """
    if check:
        found_pairs = save(pairs(docs, key), "surrogates")
        bad = clashes(found_pairs).limit(3).collect()
        drop(found_pairs)
        if bad:
            raise ValueError(f"surrogates are not distinct, such as those of kind {sorted({r.kind for r in bad})}")
    plain = docs.drop("n_replaced")
    place = plain.columns.index("text")

    def run(batches):
        own = Surrogates(key)
        for batch in batches:
            for row, end, texts in _texts(batch.column(place)):
                new, count = [], []
                for t in texts:
                    spans, at, out = found(t) if t else [], 0, []
                    for a, b, kind in spans:
                        out += [t[at:a], own.of(kind, t[a:b])[1]]
                        at = b
                    new.append("".join([*out, t[at:]]) if spans else t)
                    count.append(len(spans))
                columns = [c.slice(row, end - row) for c in batch.columns]
                columns[place] = pa.array(new, pa.string())
                yield pa.record_batch([*columns, pa.array(count, pa.int64())], names=[*batch.schema.names, "n_replaced"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(lean(run), f"{kinds}, n_replaced long")
