"""Personal data and secrets in page texts, replaced by keyed stand-ins of the same kind."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import partial

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.texts import BY, release, slices
from folioframe.session import cut_lineage

# Titles that announce a name, by the gender they tell; own stand-in first names by script and gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Mme", "Madame", "Frau", "Signora", "Sig.ra", "Dott.ssa", "Prof.ssa", "Señora", "Sra", "госпожа", "Госпожа", "κυρία", "Κυρία"),
    "m": ("Mr", "Monsieur", "Herr", "Signor", "Sig", "Dott", "Señor", "Sr", "господин", "Господин", "κύριος", "Κύριος"),
    "n": ("Dr", "Prof"),
}
FIRST_NAMES = {
    ("latin", "f"): "Ada Bianca Clara Dora Elena Flora Greta Helena Irene Julia Laura Marta Nora Olga Paola Rita Silvia Teresa Vera Wanda".split(),
    ("latin", "m"): "Aldo Bruno Carlo Dario Emil Fabio Guido Hugo Ivo Jonas Karl Luca Marco Nico Otto Paolo Remo Sergio Tito Viktor".split(),
    ("latin", "n"): "Alex Andrea Dana Eden Jamie Kim Luca Noa Robin Sascha".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Тамара".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Иван Кирилл Максим Олег Роман Фёдор".split(),
    ("cyrillic", "n"): "Женя Саша Валя Шура".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιωάννα Μαρία Νίκη Σοφία Χριστίνα".split(),
    ("greek", "m"): "Άρης Γιώργος Ηλίας Κώστας Λουκάς Νίκος Πέτρος Φώτης".split(),
    ("greek", "n"): "Άγγελος Νικόλ Παρασκευή Φανή".split(),
}
SYLLABLES = {"latin": "ba be bo da de di fa fi ga gi la le lo ma mi na ne no ra re ro sa si ta ti va vi".split(),
             "cyrillic": "ба ве га да жи ко ла ма ни по ра са то фа ши".split(), "greek": "βα γε δα κα λα μι νο πα ρα σι το φα".split()}
_TITLE_OF = {t: g for g, titles in TITLES.items() for t in titles}
_PERSON = r"(?<!\w)(?:{})\.?[  ](?P<person>[^\W\d_a-zа-яα-ω][\w'’-]*(?:[  ][^\W\d_a-zа-яα-ω][\w'’-]*){{0,2}})".format("|".join(re.escape(t) for t in sorted(_TITLE_OF, key=len, reverse=True)))
PERSON = re.compile(_PERSON)
# Capitalised words, alone and in a row.
_NAME = re.compile(r"(?<![\w@.-])[^\W\d_a-zа-яα-ω][\w'’-]*(?![\w@])")
_NAMES = re.compile(r"(?<![\w@.-])[^\W\d_a-zа-яα-ω][\w'’-]*(?:[ \u00a0][^\W\d_a-zа-яα-ω][\w'’-]*)*(?![\w@])")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# One pattern for everything that holds a digit or an @; the first kind that fits at a place wins.
CODED = re.compile("|".join([
    r"(?P<email>(?<!\w)\w[\w.%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)",
    r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:][ ]?[\"']?(?P<secret>[A-Za-z0-9_/+-]{8,})",
    r"(?P<key>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|gho_|sk-)[A-Za-z0-9]{20,})",
    r"(?P<taxcode>(?<![A-Za-z0-9])[A-Z]{6}\d\d[ABCDEHLMPRST]\d\d[A-Z]\d{3}[A-Z](?![A-Za-z0-9]))",
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    r"(?P<hex>(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,}(?![A-Za-z0-9]))",
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d))",
    r"(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))",
    r"(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-]))",
]))
_MARK = re.compile(r"[0-9@]|(?i:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:]")
ENTITY = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()),
                       T.StructField("canonical", T.StringType()), T.StructField("found", T.StringType())])


# Country codes of two digits; 1 and 7 are alone, the others have three.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def luhn(digits: str) -> int:
    """The remainder that is 0 for a valid card number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def cards_in(run: str) -> list[tuple[int, int]]:
    """Places of the valid card numbers of a run of digits; each begins and ends where a group of digits does, the longest first."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(groups):
        best, n = None, 0
        for e in range(k, len(groups)):
            n += groups[e][1] - groups[e][0]
            if n > 19:
                break
            digits = re.sub(r"\D", "", run[groups[k][0]:groups[e][1]])
            if n >= 13 and not luhn(digits) and len(set(digits)) > 1:
                best = e
        if best is None:
            k += 1
        else:
            out.append((groups[k][0], groups[best][1]))
            k = best + 1
    return out


# What a character of a tax code counts in odd places, for 0-9 and again A-J, then K-Z; in even places it is its number.
_ODD = [int(n) for n in "1 0 5 7 9 13 15 17 19 21 2 4 18 20 11 3 6 8 12 14 16 10 22 25 24 23".split()]


def tax_letter(code: str) -> str:
    """The check letter that follows the 15 characters of a tax code."""
    numbers = [int(c) if c.isdigit() else ord(c) - 65 for c in code[:15]]
    return chr(65 + sum(n if k % 2 else _ODD[n] for k, n in enumerate(numbers)) % 26)


def iban_digits(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{account}{country}00')) % 97:02d}"


def script_of(name: str) -> str:
    first = next((c for c in name if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" or "ἀ" <= first <= "῿" else "latin"


def canonical_of(kind: str, found: str, gender: str = "n") -> str:
    """What all spellings of an entity share: case and separators aside."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if found.startswith("+") else "") + re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "email":
        return found.lower()
    if kind == "person":
        return f"{gender}:{' '.join(found.split()).casefold()}"
    return found


def entities_of(text: str) -> list[tuple[int, int, str, str, str]]:
    """Start, end, kind, canonical form and found form of every entity, from left to right, not overlapping."""
    windows: list[list[int]] = []
    for m in _MARK.finditer(text):
        low, high = m.start(), m.end()
        if windows and low - windows[-1][1] <= 24:
            windows[-1][1] = high
        else:
            windows.append([low, high])
    out = []
    done = 0
    for low, high in windows:
        # from the word it begins in, and the two before (a key word and its sign), to the end of the last word
        for _ in range(3):
            while low > done and not text[low - 1].isspace():
                low -= 1
            if low > done:
                low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        for m in CODED.finditer(text, max(low, done), high):
            kind = m.lastgroup
            found = m.group(kind)
            if kind == "card":
                for start, end in cards_in(found):
                    out.append((m.start() + start, m.start() + end, kind, canonical_of(kind, found[start:end]), found[start:end]))
                continue
            if kind == "secret" and not any(c.isdigit() for c in found):
                continue
            if kind in ("secret", "key", "hex"):
                kind = "secret"
            out.append((m.start(m.lastgroup), m.end(m.lastgroup), kind, canonical_of(kind, found), found))
        done = max(done, out[-1][1] if out else 0)
    out += people_of(text)
    out.sort(key=lambda e: (e[0], -e[1]))
    kept: list[tuple[int, int, str, str, str]] = []
    for e in out:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def people_of(text: str) -> list[tuple[int, int, str, str, str]]:
    """Names after titles, and all later and earlier mentions of these people in the text.

    Mentions with one surname are one person if their given names agree or are missing; the fullest name and any title that tells the gender
    make the canonical form. Untitled mentions count if they have the surname as a title has it, alone or after the given names.
    """
    titled = []
    for m in PERSON.finditer(text):
        title = text[m.start():m.start("person")].rstrip(" .\u00a0")
        titled.append((m.start("person"), m.group("person"), _TITLE_OF.get(title) or _TITLE_OF.get(f"{title}.") or "n"))
    if not titled:
        return []
    people: list[dict] = []
    # the fullest names come first, so that a bare surname joins the one person who has it
    for _, name, gender in sorted(titled, key=lambda t: (-len(t[1].split()), t[0])):
        *given, last = name.split()
        given = [g.casefold() for g in given]
        fits = [p for p in people if p["last"].casefold() == last.casefold() and p["given"][:len(given)] == given and (gender == "n" or p["gender"] in ("n", gender))]
        if fits:
            fits[0]["gender"] = gender if fits[0]["gender"] == "n" else fits[0]["gender"]
        else:
            people.append({"last": last, "given": given, "gender": gender})
    surnames: dict[str, list[dict]] = {}
    for person in people:
        surnames.setdefault(person["last"].casefold(), []).append(person)
    spelled = {name.split()[-1] for _, name, _ in titled}
    genders = {at: gender for at, _, gender in titled}
    out = []
    for m in _NAMES.finditer(text):
        words = [(w.start(), w.end(), w.group()) for w in _NAME.finditer(text, m.start(), m.end())]
        first = 0
        for k, (start, end, word) in enumerate(words):
            if start in genders:
                first = k
            if word not in spelled:
                continue
            same = surnames[word.casefold()]
            # given names before it; words that only begin a sentence are none
            for at in range(max(first, k - 2), k + 1):
                given = [w.casefold() for _, _, w in words[at:k]]
                told = genders.get(words[at][0], "n")
                fits = [p for p in same if p["given"][:len(given)] == given and (told == "n" or p["gender"] in ("n", told))]
                if fits:
                    p = fits[0]
                    canonical = canonical_of("person", " ".join([*p["given"], p["last"]]), p["gender"])
                    out.append((words[at][0], end, "person", canonical, text[words[at][0]:end]))
                    break
            first = k + 1
    return out


class _Stream:
    """Keyed choices that depend on nothing but key, entity and attempt."""

    def __init__(self, key: bytes, *about: object):
        self.seed, self.n, self.pool = "\x1f".join(map(str, about)).encode(), 0, b""
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key).digest()
            self.n += 1
        got, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return got % n

    def alike(self, text: str, hexed: bool = False) -> str:
        """Characters of the same class, place by place."""
        out = []
        for c in text:
            if hexed:
                out.append(("0123456789ABCDEF" if text.isupper() else "0123456789abcdef")[self.below(16)])
            elif c.isdigit():
                out.append("0123456789"[self.below(10)])
            elif c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def stand_in(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of the stand-in: the same kind, length, script and gender, with valid check digits.

    Every eighth attempt makes e-mail names and numbers one place longer, so the space of stand-ins never runs out.
    """
    s = _Stream(key, kind, canonical, attempt)
    longer = "0" * (attempt // 8)
    if kind == "email":
        name, _, host = canonical.rpartition("@")
        labels = host.split(".")
        own = _Stream(key, "host", host)  # one host, one stand-in
        return f"{s.alike(name + longer)}@{'.'.join([own.alike(x) for x in labels[:-2]] + [own.alike(labels[-2]), labels[-1]])}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        digits = canonical[0] + s.alike(canonical[1:-1])
        return digits + str((10 - luhn(f"{digits}0")) % 10)
    if kind in ("phone", "ssn"):
        keep = 0
        if canonical.startswith("+"):
            keep = 2 if canonical[1] in "17" else 3 if canonical[1:3] in _TWO_DIGITS else 4
        keep = min(len(canonical) - 4, keep)
        return canonical[:keep] + s.alike(canonical[keep:] + longer)
    if kind == "iban":
        account = s.alike(canonical[4:])
        return canonical[:2] + iban_digits(canonical[:2], account) + account
    if kind == "taxcode":  # the day tells the gender: above 40 for women
        day = 1 + s.below(28) + (40 if int(canonical[9:11]) > 40 else 0)
        code = f"{s.alike(canonical[:8])}{'ABCDEHLMPRST'[s.below(12)]}{day:02d}{s.alike(canonical[11:15])}"
        return code + tax_letter(code)
    if kind == "person":
        gender, _, name = canonical.partition(":")
        script, words = script_of(name), name.split(" ")
        firsts = FIRST_NAMES[script, gender]
        last = "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(3 + attempt // 4)).capitalize()
        given = [firsts[s.below(len(firsts))] for _ in words[1:]]
        return f"{gender}:{' '.join([*given, last])}"
    head = re.match(r"AKIA|ASIA|ghp_|gho_|sk-", canonical)
    cut = head.end() if head else 0
    return canonical[:cut] + s.alike(canonical[cut:], re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", canonical) is not None)


def shaped(kind: str, stand: str, found: str) -> str:
    """A stand-in in the spelling of the place it goes to."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(stand.lstrip("+"))
        return "".join(next(left) if c.isalnum() else c for c in found) + "".join(left)
    if kind == "person":
        *given, last = stand.partition(":")[2].split(" ")
        stand = " ".join([*given[:len(found.split()) - 1], last])
        return stand.upper() if found.isupper() and len(found) > 1 else stand
    if kind == "email":
        return stand.upper() if found.isupper() else stand
    return stand


def _entities(batches):
    release("")
    for batch in batches:
        for part in slices(batch, pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()):
            rows = {(k, e[2], e[3]) for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if text for e in entities_of(text)}
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["row_key", "kind", "canonical"])


def _stand_ins(batches, key):
    for batch in batches:
        kind, canonical, attempt = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([stand_in(key, *x) for x in zip(kind, canonical, attempt)], pa.string())],
                                         names=["kind", "canonical", "attempt", "stand"])


_STATE = "kind string, canonical string, attempt int, stand string"


def settled(entities: DataFrame, key: bytes) -> DataFrame:
    """Entities whose first stand-in was taken, with one that is free: ``kind``, ``canonical``, ``attempt``, ``stand``.

    ``entities`` are distinct ``kind, canonical``. A stand-in is taken if it is itself an entity of the corpus or if an
    entity that comes first in order has it. Those that lose try again; nobody else changes.
    """
    make = partial(_stand_ins, key=key)
    state = cut_lineage(entities.select("kind", "canonical", F.lit(0).alias("attempt")).mapInArrow(make, _STATE))
    real = entities.select("kind", F.col("canonical").alias("stand"))
    moved = state.where("attempt > 0")
    while True:
        # who tried least often stays; among equals the first in order
        first = state.groupBy("kind", "stand").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = state.join(first, ["kind", "stand"]).where("canonical != first.canonical").select("kind", "canonical")
        copied = state.join(real, ["kind", "stand"], "left_semi").select("kind", "canonical")
        losers = cut_lineage(shared.union(copied).distinct())
        if losers.isEmpty():
            return moved
        again = state.join(losers, ["kind", "canonical"]).select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")).mapInArrow(make, _STATE)
        state = cut_lineage(state.join(losers, ["kind", "canonical"], "left_anti").select("kind", "canonical", "attempt", "stand").union(again))
        moved = state.where("attempt > 0")


def _rewrite(batches, key, text, over, names, kept):
    release("")
    for batch in batches:
        for part in slices(batch, pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()):
            texts, entities, made = [], [], {}
            for value, taken in zip(part.column(text).to_pylist(), part.column(over).to_pylist()):
                rows, pieces, at = [], [], 0
                others = {(o["kind"], o["canonical"]): o["stand"] for o in taken or ()}
                for start, end, kind, canonical, found in entities_of(value) if value else ():
                    stand = others.get((kind, canonical)) or made.get((kind, canonical))
                    if stand is None:
                        stand = made[kind, canonical] = stand_in(key, kind, canonical)
                    shown = shaped(kind, stand, found)
                    pieces += [value[at:start], shown]
                    at = end
                    rows.append({"start": start, "end": end, "kind": kind, "stand_in": shown})
                texts.append(value if not rows else "".join([*pieces, value[at:]]))
                entities.append(rows)
            columns = [part.column(k) for k in kept]
            columns[kept.index(text)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(entities, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("stand_in", pa.string())])))], names=names)


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("stand_in", T.StringType())]))


def replace_entities(pages: DataFrame, key: bytes, text: str = "text", by: Sequence[str] = BY, carry: Sequence[str] = ()) -> DataFrame:
    """``by``, ``carry`` and ``text`` with every entity replaced, and ``entities`` (start, end, kind, stand_in).

    Kinds: e-mail, secret, tax code, IBAN, IP, phone, social security number, card, person (a name after a title, and every other mention in that text). A
    stand-in depends on ``key`` and the entity alone, so it is the same on every page; it keeps length, separators,
    country, issuer, check digit, gender and script. Different entities get different stand-ins, none of which is an
    entity of the corpus: the few that would clash are found by a join over all entities and drawn again.
    IBANs and tax codes count as found even if mistyped; their stand-ins are valid.
    Places count characters of the original. An empty table gives no rows; texts are read whole. Null texts stay null and have no entities; repeated rows stay. Texts are
    not shuffled unless clashes are so many that their pages can't be sent along.
    """
    keep = [c for c in dict.fromkeys([*by, *carry]) if c not in (text, "entities")]
    slim = pages.select(*keep, F.col(text).cast("string").alias(text))
    row_key = F.xxhash64(*by)  # equal for a few pages by chance: they only learn of more stand-ins
    found = cut_lineage(slim.select(row_key.alias("row_key"), F.col(text).alias("text")).mapInArrow(_entities, "row_key long, kind string, canonical string"), compression="zstd")
    moved = settled(found.select("kind", "canonical").distinct(), key)
    # written, so that its size is known and texts stay where they are if it is small
    over = cut_lineage(found.join(moved, ["kind", "canonical"]).groupBy("row_key").agg(F.collect_set(F.struct("kind", "canonical", "stand")).alias("__over")))
    joined = slim.withColumn("row_key", row_key).join(over, "row_key", "left").select(*keep, text, "__over")
    schema = T.StructType([*slim.schema.fields, T.StructField("entities", FOUND)])
    at = len(keep)
    return joined.mapInArrow(partial(_rewrite, key=key, text=at, over=at + 1, names=schema.names, kept=list(range(at + 1))), schema)
