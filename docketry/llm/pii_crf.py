"""Personal data: exact patterns, and a linear-chain conditional random field that adds spans.

The patterns (email, ip, card, phone) are the base. The field labels every word of every line from
its own shape and its neighbours' shapes; it is trained here from a small labelled table and decoded
by Viterbi over many word sequences at once. A labelled run that meets no base span becomes a span
of its own: further emails, addresses, numbers and phones, and the kinds `id`, `secret`, `name` (two
words or more) and `address` (with a digit), which are the field's alone. Names end at a mark and
addresses at a sentence, whatever the labels say; digests without a key beside them are no secrets.

Most words of a text are certain to lie outside: their score there leads every other label's by more
than two label pairs can make up, whatever stands beside them. They cut a line into short
sequences, which are decoded with those words as fixed ends, so the result is that of the whole line.

Shapes of plain words come from the text's bytes by array operations; only words with digits or
marks inside are looked at one by one. Every pattern is matched so that its time is linear in the
text: runs are taken whole, and an address is sought from its at sign outwards.

Defined results: a null text counts as empty and has no spans. Repeated rows are searched alike. An
empty table gives an empty result. Extra columns are ignored by the search and kept by the redaction.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._words import LOWER_CODE, Buffer, buffer_of, range_hashes, row_groups, words_of

#: Kinds in their order of report: those of the patterns, then the field's own.
KINDS = ("email", "ip", "card", "phone", "id", "secret", "name", "address")
BASE_KINDS = KINDS[:4]
LABELS = ("O", *KINDS)
EPOCHS, SENTENCES, SEED = 90, 3000, 11
#: Words of uncertain label that are decoded at once.
AT_ONCE = 1 << 15

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Marks that are stripped from a word's ends.
EDGE = ".,;:!?\"'()[]{}<>#$%&*|~`"
_IS_EDGE = np.zeros(256, dtype=bool)
_IS_EDGE[[ord(c) for c in EDGE]] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[65:91] = True
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS_HEAD = (np.arange(256) & 0xC0) != 0x80
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns by kind, then start; a match that fails its test is dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: Cases of a plain word's core: all small, one capital alone, all capitals, capital first, other.
CASES = ("x", "X", "XX", "Xx", "xX")


def _plain_features(lead: str, trail: str, case: int, length: int) -> tuple[str, ...]:
    """Of a word that is letters only between its edges: length in steps of three letters, up to 5."""
    return ("lead=" + lead, "trail=" + trail, "case=" + CASES[case], f"length={length}", f"lead={lead} case={CASES[case]}")


def _odd_features(core: str, lead: str, trail: str) -> tuple[str, ...]:
    """Of a word with digits or marks inside it."""
    exact = re.sub(r"[^\x00-\x7F]", "x", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", re.sub(r"[0-9]", "9", core[:64]))))
    short = re.sub(r"(.)\1+", r"\1", exact)
    digits = sum(c in "0123456789" for c in core)
    mix = "".join(k for k in "xX9" if k in exact)
    turns = sum(a != b for a, b in zip(exact, exact[1:], strict=False))
    name, sep, value = core.partition("=") if "=" in core else core.partition(":")
    out = ["odd", "lead=" + lead, "trail=" + trail, "shape=" + short[:14], f"digits={min(digits, 20)}", f"size={min(len(core), 64) // 4}", "mix=" + mix, f"mixed={mix} {min(len(core), 40) // 8} {min(turns, 12) // 3}", "marks=" + "".join(sorted({c for c in core if not c.isalnum()}))[:6]]
    if len(core) <= 20:
        out.append("exact=" + exact)
    if core[:1].isalpha():
        out.append("start=" + core[:4].translate(_ASCII_LOWER))
    if sep and value:
        out.append("key=" + re.split(r"[._-]", name.translate(_ASCII_LOWER))[-1][:16])
    if "@" in core:
        out.append("at")
    return tuple(out)


def word_features(word: str) -> tuple[str, ...]:
    """Shape, size and edges of a word, and its letters where it is plain."""
    core = word.strip(EDGE)
    lead = word[0] if core and word[0] != core[0] else ""
    trail = word[word.index(core) + len(core) :][:1] if core else word[:1]
    raw = np.frombuffer(core.encode("utf-8", "surrogatepass"), np.uint8)
    if not core or not _IS_LETTER[raw].all():
        return _odd_features(core, lead, trail)
    n, upper = len(core), int(_IS_UPPER[raw].sum())
    case = 0 if not upper else (1 if n == 1 else 2) if upper == n else 3 if upper == 1 and _IS_UPPER[raw[0]] else 4
    return (*_plain_features(lead, trail, case, min(n, 15) // 3), "word=" + core.translate(_ASCII_LOWER))


# Given names and family names common in four languages, and words of addresses.
GIVEN = "ahmed mohammed omar fatima aisha yusuf mehmet elif priya raj anita wei mei yuki hiroshi olga ivan dmitri sven ingrid joao ana rui pedro tiago beatriz marco giulia paolo kofi amara anna emma marie julia laura sofia maria elena clara louise alice camille ines lucia carmen isabel jane mary susan linda john peter james robert michael david thomas daniel paul martin lukas felix jonas hans klaus jean pierre michel luc antoine hugo jose luis carlos miguel javier pablo diego george henry".split()
FAMILY = "silva santos ferreira pereira costa oliveira hassan khan demir yilmaz raman patel singh kumar zhang wang chen nguyen kim tanaka ivanov novak kowalski jensen hansen rossi okafor mensah smith johnson brown taylor miller davis wilson clark doe white schmidt schneider fischer weber meyer wagner becker hoffmann dubois laurent bernard moreau girard lefebvre mercier garcia martinez lopez sanchez romero torres navarro ruiz".split()
STREET_AFTER = "street road avenue lane drive court square boulevard way".split()
STREET_BEFORE = "rua praça travessa via rue avenue boulevard calle plaza avenida paseo chemin".split()
STREET_END = "strasse straße weg platz gasse allee".split()
CITIES = "london paris berlin madrid lyon hamburg munich sevilla boston leeds york nantes lisboa porto vienna".split()
# Plain words of the four languages, and words that announce a kind.
PLAIN = "the of and to in is that for with was his on at by are from this have not le la les des et dans que pour un une sur est par der die und das nicht ein zu mit von auf ist im el los las por con no para su del se al como".split()
CUES = {
    "email": "email mail contact write correo courriel e-mail".split(),
    "ip": "ip address host server from adresse".split(),
    "card": "card visa carte tarjeta karte payment mastercard".split(),
    "phone": "phone call tel mobile fax telefon teléfono ring".split(),
    "id": "ssn nif iban passport id steuernummer dni insee konto account".split(),
    "secret": "password token key secret passwort clave credential apikey".split(),
    "name": "mr mrs dr ms herr frau monsieur madame señor señora mme sr name contact signed dear".split(),
    "address": "address adresse dirección at lives wohnt".split(),
}


def labelled_table(seed: int = SEED, sentences: int = SENTENCES) -> list[list[tuple[str, str]]]:
    """The training table: word and label, sentence by sentence, from public forms of each kind."""
    rng = random.Random(seed)
    pick, chance = rng.choice, rng.random
    letters, lower, hexed, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, a, b=0: "".join(pick(chars) for _ in range(rng.randrange(a, (b or a) + 1)))
    d = lambda a, b=0: some("0123456789", a, b)

    def invented(most: int = 5) -> str:
        return "".join(pick("aeiouéèáöü" if k % 2 else lower) + (pick("nrstl") if chance() < 0.3 else "") for k in range(rng.randrange(1, 2 * most)))

    def mark() -> str:
        return pick([".", ",", ";", "!", "!!", "?", ":", '."', "###", "&&&", "%%%", "$$$", "***"])

    def plain() -> list[str]:
        """Running words: small function words, invented ones, capitals anywhere, marks behind."""
        out = []
        for _ in range(rng.randrange(1, 8)):
            w = pick(PLAIN) if chance() < 0.5 else invented()
            r = chance()
            w = w.capitalize() if r < 0.18 else w.upper() if r < 0.22 else w
            out.append(w + (mark() if chance() < 0.2 else ""))
        return out

    def prose() -> list[str]:
        """Whole sentences of invented words, of one word or more, in a row."""
        out = []
        for _ in range(rng.randrange(1, 4)):
            words = [pick(PLAIN) if chance() < 0.4 else invented() for _ in range(pick([1, 1, 2, 3, rng.randrange(4, 10)]))]
            words[0] = words[0].capitalize()
            words = [w + "," if chance() < 0.08 else w for w in words]
            out += [*words[:-1], words[-1].rstrip(",") + pick([".", ".", ".", "", "!", "?"])]
        return out

    def name() -> str:
        first, last = pick(GIVEN).capitalize(), (pick(FAMILY) if chance() < 0.5 else invented(3)).capitalize()
        return pick([f"{first} {last}", f"{first} {last}", f"{first} {pick(letters)}. {last}", f"{first} {last}-{invented(2).capitalize()}"])

    def value(kind: str) -> str:
        if kind == "email":
            who, host, top = pick([pick(GIVEN), invented(), f"{pick(GIVEN)}.{pick(FAMILY)}", f"{pick(lower)}{pick(FAMILY)}{d(1, 4)}", f"{pick(GIVEN)}_{d(2)}"]), pick([invented(), f"{invented()}-{invented()}", f"{invented()}.{invented()}", invented() + d(1, 2)]), pick("com org net de fr es io co.uk eu info".split())
            return pick([f"{who}@{host}.{top}"] * 4 + [f"{who} (at) {invented()} (dot) {top}", f"{who} [at] {invented()} [dot] {top}", f"{who}(at){invented()}.{top}", f"{who}@{host}"])
        if kind == "ip":
            return pick([".".join(str(rng.randrange(256)) for _ in range(4)), ":".join(some(hexed, 1, 4) for _ in range(8)), f"{some(hexed, 4)}:{some(hexed, 4)}::{some(hexed, 1, 4)}"])
        if kind == "card":
            return pick([d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(6)} {d(5)}", d(15)])
        if kind == "phone":
            return pick([f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2, 3)} {d(3)} {d(3, 4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(10, 13)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2, 3)}/{d(5, 8)}", f"{d(3)}.{d(3)}.{d(4)}"])
        if kind == "id":
            iban = pick(["DE", "FR", "ES", "PT", "IT", "GB"]) + d(2)
            return pick([f"{d(3)}-{d(2)}-{d(4)}", iban + d(16, 22), f"{iban} {d(4)} {d(4)} {d(4)} {d(4)}" + pick(["", f" {d(2)}"]), f"{d(8)}{pick(letters)}", f"{pick(letters)}{d(7, 8)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}"])
        if kind == "secret":
            word, long = pick(["password", "passwd", "pwd", "token", "api_key", "apikey", "secret", "access_token", "auth", "client_secret", "private_key"]), some(mixed, 20, 64)
            random_part = pick([some(hexed, 24, 64), some(hexed, 40), long, some(mixed + "+/", 24, 44) + "=", some(mixed, 12, 24), some(mixed + "_-", 16, 40)])
            bare = pick([long, some(mixed + "+/", 24, 44) + "=", some(mixed, 24, 36)])
            weak = invented() + d(1, 4) + pick(["", "!", "#", invented(2), some(mixed, 2, 5)])
            return pick([f"{word}={weak}", f"{word}={random_part}", f"{word}:{random_part}", f'"{bare}"', bare, f"ghp_{some(mixed, 36)}", f"sk-{some(mixed, 24, 48)}", f"{some(lower, 2, 4)}_{pick([some(hexed, 20, 40), long])}", f"xoxb-{d(10, 12)}-{some(mixed, 20, 24)}", some(letters, 4) + some(letters + "0123456789", 12, 16), f"eyJ{some(mixed, 16, 30)}.eyJ{some(mixed, 16, 40)}.{some(mixed + '_-', 20, 43)}", f"AIza{some(mixed + '_-', 35)}"])
        if kind == "name":
            return name()
        city = pick([pick(CITIES).capitalize(), invented(4).capitalize()])
        road = invented(4).capitalize()
        house = d(1, 3) + pick(["", "", "", pick("abB")])
        street = pick([f"{house} {road} {pick(STREET_AFTER).capitalize()}", f"{d(1, 3)} {pick(STREET_BEFORE)} {pick(['de', 'du', 'de la', 'del'])} {road}", f"{pick(STREET_BEFORE).capitalize()} {road} {house}", f"{pick(STREET_BEFORE).capitalize()} {pick(['das', 'dos', 'da', 'do', 'de', 'della'])} {road} {house}", f"{road}{pick(STREET_END)} {house}", f"{road} {pick(STREET_END).capitalize()} {d(1, 3)}"])
        return pick([street, f"{street}, {city}", f"{street}, {d(5)} {city}"])

    def other() -> str:
        """What looks like personal data and is none."""
        return pick([d(1) + ".", f"{d(1)}.0.", f"{d(1)}.{d(1)}", f"19{d(2)}", f"20{d(2)}", f"${d(2)}.{d(2)}", f"{d(1, 3)},{d(3)}", f"{d(1, 2)}%", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(2)}/{d(2)}/20{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"#{d(4)}", f"@{invented()}", d(2, 6), f"{d(2)}:{d(2)}", f"chapter {d(1, 2)}", f"{d(1, 2)} {invented()}", f"{invented().capitalize()} {d(1, 2)}", f"{invented()}-{invented()}", f"{invented()}'{invented()}", f"{invented()}.{invented().capitalize()}", f"{invented()}_{invented()}", f"https://www.{invented()}.com/{invented()}/{d(1, 4)}", f"www.{invented()}.org", f"{invented()}.html", f"{invented()}={d(1, 3)}", f"{invented()} = {invented()}", f"{invented()}/{invented()}", f"{d(1, 3)}{pick(['km', 'kg', 'm', 'th', 'nd', 'px'])}", f"({d(1, 2)})", f"[{d(1, 2)}]", "=", "-", "--", f"<{invented()}>", f"{pick(STREET_AFTER).capitalize()} {invented()}", f"{pick(FAMILY).capitalize()}", pick(CITIES).capitalize(), f"The {invented().capitalize()} {invented().capitalize()}", f"{invented().capitalize()} {invented().capitalize()}", f"{some(letters, 2)} {some(letters, 2)}-{some(letters, 2)} {d(1)}.{d(1)}", f"{pick(['version', 'Version', 'v.', 'Release', 'No.', 'page', 'Art.'])} {d(1)}{pick(['', '.' + d(1)])}", f"{pick(STREET_BEFORE)} {invented()}", f"{pick(['De', 'La', 'Del', 'Du', 'El'])} {invented()}", some(letters, 2, 5)])

    def repeated() -> list[str]:
        """One word many times over."""
        w = invented() if chance() < 0.8 else pick(PLAIN)
        w = (w.capitalize() if chance() < 0.6 else w) + pick(["", "", ".", ","])
        return [w] * rng.randrange(2, 12) + ([invented().capitalize()] * rng.randrange(2, 6) if chance() < 0.4 else [])

    def headline() -> list[str]:
        """Sentences of one or two words, each with its capital."""
        return [w + pick([".", ".", "!", ","]) if chance() < 0.7 else w for w in (invented().capitalize() for _ in range(rng.randrange(2, 7)))]

    def licence() -> list[str]:
        """Notices: capitals in a row beside versions, and no personal data."""
        title = " ".join(invented(4).capitalize() for _ in range(rng.randrange(1, 4)))
        kind = pick(["License", "License", "Public License", "General Public License", "Agreement", "Licence"])
        start = pick(["This work is licensed under the", "Licensed under the", "Released under the", "Distributed under the terms of the", "See the", "This program comes under the"])
        return f"{start} {title} {kind}, {pick(['version', 'Version', 'v.'])} {d(1)}{pick(['', '.' + d(1)])}{pick(['.', '', ' or later.'])}".split()

    def digest() -> list[str]:
        """Digests and revisions of public things."""
        hexes = pick([some(hexed, 40), some(hexed, 64), some(hexed, 32), some(hexed, 7, 12)])
        return pick([f"commit {hexes}", f"see {hexes} for", f"sha256:{hexes}", f"md5: {hexes}", f"revision {hexes}.", hexes, f"{invented()} {hexes} {invented()}", f"checksum {hexes}"]).split()

    table = []
    for n in range(sentences):
        if chance() < 0.12:  # what is often taken for a name, an address or a secret
            table.append([(w, "O") for w in pick([repeated, headline, licence, digest])()])
            continue
        if chance() < 0.04:  # a person and where they live
            cue = [(pick(CUES["name"]).capitalize() + pick(["", ":", "."]), "O")] if chance() < 0.5 else []
            table.append([*cue, *((w, "name") for w in (name() + ",").split()), *((w, "address") for w in value("address").split())])
            continue
        if chance() < 0.15:  # a line of few words
            table.append([(w, "O") for w in prose()[: pick([1, 2, 3, 4])]])
            continue
        words = [(w, "O") for w in (prose() if n % 4 == 0 else plain() if chance() < 0.85 else [])]
        for _ in range(rng.randrange(1, 3)):
            if n % 4 == 0:
                words += [(w, "O") for w in prose()]
            elif n % 4 == 1:
                words += [(w, "O") for w in other().split()]
            else:
                kind = KINDS[rng.randrange(len(KINDS))] if chance() < 0.6 else pick(["name", "address", "secret"])
                if chance() < 0.35:
                    cue = pick(CUES[kind])
                    words += [(w, "O") for w in ((cue.capitalize() if kind == "name" or chance() < 0.3 else cue) + pick(["", ":", " =", " is"] if kind != "name" else ["", "."])).split()]
                words += [(w, kind) for w in (value(kind) + pick(["", "", ".", ",", mark()])).split()]
            words += [(w, "O") for w in (plain() if chance() < 0.85 else [])]
        table.append(words)
    return table


class Field:
    """Weights of the chain: of each feature at the word, before it and after it, and of label pairs."""

    def __init__(self, weights: dict[str, np.ndarray], pairs: np.ndarray):
        """weights: of each feature, rows for the word itself, the one after it and the one before it."""
        self.weights, self.pairs = weights, pairs
        lexicon = sorted(f[5:] for f in weights if f.startswith("word="))
        column = pa.array(lexicon, pa.string())
        buf = buffer_of(column)
        keys = range_hashes(buf.data, buf.start, buf.end, LOWER_CODE) if lexicon else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.word_keys = keys[order]
        self.word_rows = np.stack([weights["word=" + lexicon[k]] for k in order]) if lexicon else np.zeros((0, 3, len(LABELS)))
        #: By what lead over each other label a word is outside, whatever lies beside it.
        before, after = (pairs - pairs[:, :1]).max(0), (pairs - pairs[:1]).max(1)
        self.need = (np.maximum(before, 0) + np.maximum(after, 0))[1:].astype(np.float32)

    def _sum(self, features: tuple[str, ...]) -> np.ndarray:
        out = np.zeros((3, len(LABELS)))
        for f in features:
            if (w := self.weights.get(f)) is not None:
                out += w
        return out

    def emission(self, word: str) -> np.ndarray:
        return self._sum(word_features(word))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of a sequence's words by label."""
        each = np.stack([self.emission(w) for w in words])
        out = each[:, 0].copy()
        out[1:] += each[:-1, 1]
        out[:-1] += each[1:, 2]
        return out

    def rows_of(self, buf: Buffer, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word, table of rows): the parts that each word gives to its own and its neighbours' scores."""
        base = int(start[0])
        data = buf.data[base : int(end[-1])]
        s, e = start - base, end - base
        for _ in range(4):  # longer runs of marks leave an odd word
            e = e - ((e > s) & _IS_EDGE[data[e - 1]])
        for _ in range(4):
            s = s + ((s < e) & _IS_EDGE[data[np.minimum(s, len(data) - 1)]])
        lead = np.where((s > start - base) & (e > s), data[start - base], 0).astype(np.int64)
        trail = np.where(e < end - base, data[np.minimum(e, len(data) - 1)], 0).astype(np.int64)

        def count(flags: np.ndarray) -> np.ndarray:
            total = np.zeros(len(data) + 1, np.int32)
            np.cumsum(flags[data], out=total[1:])
            return (total[e] - total[s]).astype(np.int64)

        plain = (e > s) & (count(_IS_LETTER) == e - s)
        upper, n = count(_IS_UPPER), count(_IS_HEAD)
        first = _IS_UPPER[data[np.minimum(s, len(data) - 1)]]
        case = np.where(upper == 0, 0, np.where(upper == n, np.where(n == 1, 1, 2), np.where((upper == 1) & first, 3, 4)))
        word = np.full(len(s), -1, np.int64)
        at = np.flatnonzero(plain)
        if len(self.word_keys) and len(at):
            key = range_hashes(data, s[at], e[at], LOWER_CODE)
            spot = np.searchsorted(self.word_keys, key)
            spot[spot == len(self.word_keys)] = 0
            word[at] = np.where(self.word_keys[spot] == key, spot, -1)
        code = ((((lead * 256 + trail) * len(CASES) + case) * 8 + np.minimum(n, 15) // 3) * (len(self.word_keys) + 1)) + word + 1
        inverse, kinds = pd.factorize(code[at])
        table = []
        for k in kinds.tolist():
            k, w = divmod(k, len(self.word_keys) + 1)
            k, length = divmod(k, 8)
            k, c = divmod(k, len(CASES))
            a, b = divmod(k, 256)
            part = self._sum(_plain_features(chr(a) if a else "", chr(b) if b else "", c, length))
            table.append(part + self.word_rows[w - 1] if w else part)
        row = np.zeros(len(s), np.int64)
        row[at] = inverse
        odd = np.flatnonzero(~plain)
        seen: dict[bytes, int] = {}
        for k, a, b in zip(odd.tolist(), start[odd].tolist(), end[odd].tolist(), strict=True):
            raw = buf.data[a:b].tobytes()
            if (spot := seen.get(raw)) is None:
                spot = seen[raw] = len(table)
                table.append(self.emission(raw.decode("utf-8", "replace")))
            row[k] = spot
        return row, np.stack(table).astype(np.float32) if table else np.zeros((0, 3, len(LABELS)), np.float32)

    def label(self, buf: Buffer, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label of every word; first: the words that begin a line."""
        out = np.zeros(len(start), np.int8)
        if not len(start):
            return out
        row, table = self.rows_of(buf, start, end)
        score = table[row, 0]
        inner = np.flatnonzero(~first)
        score[inner] += table[row[inner - 1], 1]
        score[inner - 1] += table[row[inner], 2]
        doubt = (score[:, :1] - score[:, 1:] <= self.need).any(1)
        at = np.flatnonzero(doubt)
        if not len(at):
            return out
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) > 1) | first[at[1:]]
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(at)))
        e = score[at].astype(np.float64)
        e[heads] += np.where(first[at[heads], None], 0.0, self.pairs[0])
        tails = at[heads + sizes - 1]
        goes_on = (tails + 1 < len(start)) & ~np.append(first, True)[tails + 1]
        e[heads + sizes - 1] += np.where(goes_on[:, None], self.pairs[:, 0], 0.0)
        width = np.where(sizes <= 4, sizes, -(-sizes // 4) * 4)
        for w in np.unique(width).tolist():
            members = np.flatnonzero(width == w)
            step = max(1, AT_ONCE // w)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                spots = heads[part, None] + np.arange(w)
                live = np.arange(w) < sizes[part, None]
                best = self.viterbi(e[np.where(live, spots, 0)], live)
                out[at[spots[live]]] = best[live]
        return out

    def viterbi(self, e: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Best labels of sequences that advance together; e: [sequence, place, label]; live: places before a sequence's end."""
        m, width, _ = e.shape
        back = np.zeros(e.shape, np.int8)
        score, stay = e[:, 0], np.arange(len(LABELS), dtype=np.int8)
        into = self.pairs.T.copy()
        for t in range(1, width):
            paths = score[:, None, :] + into
            back[:, t] = np.where(live[:, t, None], paths.argmax(2), stay)
            score = np.where(live[:, t, None], paths.max(2) + e[:, t], score)
        best = np.zeros((m, width), np.int8)
        label = score.argmax(1)
        for t in range(width - 1, -1, -1):
            best[:, t] = label
            label = back[np.arange(m), t, label]
        return best

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each sequence of words."""
        column = pa.array([" ".join(x) for x in sequences], pa.string())
        buf = buffer_of(column)
        w = words_of(buf, slice(0, len(sequences)))
        first = np.ones(len(w), dtype=bool)
        first[1:] = w.row[1:] != w.row[:-1]
        best = self.label(buf, w.start, w.end, first)
        return np.split(best, np.searchsorted(w.row, np.arange(1, len(sequences)))) if sequences else []


def train_field(table: list[list[tuple[str, str]]], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood with a quadratic penalty, by scaled forward and backward sums and Adam."""
    index: dict[str, int] = {}
    words: dict[str, int] = {}
    n_labels, n, width = len(LABELS), len(table), max(map(len, table))
    sizes = np.array([len(x) for x in table])
    spot = np.array([words.setdefault(w, len(words)) for x in table for w, _ in x])
    gold = np.array([LABELS.index(label) for x in table for _, label in x])
    pairs_of = [(k, index.setdefault(f, len(index))) for word, k in words.items() for f in word_features(word)]
    owner, feature = np.array([p[0] for p in pairs_of]), np.array([p[1] for p in pairs_of])
    by_feature = np.argsort(feature, kind="stable")
    feature_starts = np.searchsorted(feature[by_feature], np.arange(len(index)))
    owner_starts = np.searchsorted(owner, np.arange(len(words)))
    by_word = np.argsort(spot, kind="stable")
    word_starts = np.searchsorted(spot[by_word], np.arange(len(words)))
    live = np.arange(width) < sizes[:, None]
    inner = np.ones(len(spot), dtype=bool)
    inner[np.cumsum(sizes) - sizes] = False
    inner = np.flatnonzero(inner)
    w, pairs = np.zeros((len(index), 3 * n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, pairs)]
    truth = np.eye(n_labels, dtype=np.float32)[gold]
    true_pairs = np.zeros_like(pairs)
    np.add.at(true_pairs, (gold[inner - 1], gold[inner]), 1)
    for step in range(1, epochs + 1):
        rows = np.add.reduceat(w[feature], owner_starts, axis=0)[spot].reshape(-1, 3, n_labels)
        flat = rows[:, 0].copy()
        flat[inner] += rows[inner - 1, 1]
        flat[inner - 1] += rows[inner, 2]
        e = np.ones((n, width, n_labels), np.float32)
        e[live] = np.exp(flat - flat.max(1, keepdims=True)) + 1e-30
        move = np.exp(pairs - pairs.max())
        ahead, behind = np.ones_like(e), np.ones_like(e)
        ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, width):
            on = np.flatnonzero(live[:, t])
            x = (ahead[on, t - 1] @ move) * e[on, t]
            ahead[on, t] = x / x.sum(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            on = np.flatnonzero(live[:, t + 1])
            x = (behind[on, t + 1] * e[on, t + 1]) @ move.T
            behind[on, t] = x / x.sum(1, keepdims=True)
        ahead, behind, e = ahead[live], behind[live], e[live]
        each = ahead * behind
        gap = each / each.sum(1, keepdims=True) - truth
        left, right = ahead[inner - 1], (behind * e)[inner]
        weight = 1 / ((left @ move) * right).sum(1, keepdims=True)
        grad_p = move * ((left * weight).T @ right) - true_pairs + 0.1 * pairs
        sides = np.zeros((len(spot), 3, n_labels), np.float32)
        sides[:, 0] = gap
        sides[inner - 1, 1] = gap[inner]
        sides[inner, 2] = gap[inner - 1]
        for_word = np.add.reduceat(sides.reshape(len(spot), -1)[by_word], word_starts, axis=0)
        grad_w = np.add.reduceat(for_word[owner[by_feature]], feature_starts, axis=0) + 0.1 * w
        for x, g, s in ((w, grad_w, state[0]), (pairs, grad_p, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x -= 0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    w, pairs = w.astype(float), pairs.astype(float)
    return Field({f: w[k].reshape(3, n_labels) for f, k in index.items()}, pairs)


@cache
def default_field() -> Field:
    """The field of the labelled table, fitted once by a driver."""
    return train_field(labelled_table())


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _parts(kind: str, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A labelled run in pieces: a name ends with a word that has a mark behind it, an address with a sentence; initials and short forms go on."""
    if kind not in ("name", "address"):
        yield a, b
        return
    ends, start = (EDGE if kind == "name" else ".!?"), None
    for m in _WORD.finditer(text, a, b):
        start = m.start() if start is None else start
        short = m[0].endswith(".") and len(m[0].strip(EDGE)) <= (1 if kind == "name" else 3)
        if m[0][-1] in ends and not short:
            yield start, m.end()
            start = None
    if start is not None:
        yield start, b


def _able(kind: str, inside: str) -> bool:
    """A name has two words or more, no two alike, and begins and ends with a capital, not with an initial; an address has a digit."""
    if kind == "name":
        words = [w.strip(EDGE) for w in inside.split()]
        return len(words) > 1 and len(set(words)) == len(words) and len(words[0]) > 1 and words[0][0].isupper() and words[-1][:1].isupper()
    return kind != "address" or bool(_DIGIT.search(inside))


def all_spans(column: pa.Array, field: Field) -> Iterator[tuple[slice, list[tuple[str, list[Span], list[Span]]]]]:
    """Runs of rows, and (text, base spans, added spans) of each of their texts."""
    buf = buffer_of(column)
    for rows in row_groups(buf):
        w = words_of(buf, rows)
        lo, hi = int(buf.start[rows].min()), int(buf.end[rows].max())
        heads = np.zeros(hi - lo + 1, np.int64)
        np.cumsum(_IS_HEAD[buf.data[lo:hi]], out=heads[1:])
        lines = np.searchsorted(np.flatnonzero(buf.data[lo:hi] == 10) + lo, w.start)
        first = np.ones(len(w), dtype=bool)
        first[1:] = (lines[1:] != lines[:-1]) | (w.row[1:] != w.row[:-1])
        label = field.label(buf, w.start, w.end, first)
        named = np.flatnonzero(label)
        fresh = np.ones(len(named), dtype=bool)
        fresh[1:] = (np.diff(named) > 1) | (label[named[1:]] != label[named[:-1]]) | first[named[1:]]
        begin, stop = named[fresh], named[np.append(fresh[1:], True)] if len(named) else named
        found = [[] for _ in range(rows.stop - rows.start)]
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            row = int(w.row[a])
            zero = heads[buf.start[row] - lo]
            found[row - rows.start].append((LABELS[label[a]], int(heads[w.start[a] - lo] - zero), int(heads[w.end[b] - lo] - zero)))
        out = []
        for k, (s, e) in enumerate(zip(buf.start[rows].tolist(), buf.end[rows].tolist(), strict=True)):
            text = buf.data[s:e].tobytes().decode("utf-8", "surrogatepass")
            base, added = base_spans(text), []
            for kind, whole_a, whole_b in found[k]:
                for a, b in _parts(kind, text, whole_a, whole_b):
                    inside = text[a:b]
                    a += len(inside) - len(inside.lstrip(EDGE))
                    b -= len(inside) - len(inside.rstrip(EDGE))
                    if a < b and _able(kind, text[a:b]) and not any(x < b and a < y for _, x, y in base):
                        added.append((kind, a, b))
            out.append((text, base, added))
        yield rows, out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (all of them) of every whole text."""
    field = field or default_field()
    counts = [f"n_{k}" for k in BASE_KINDS]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, found in all_spans(b.column("text"), field):
                cols = {"doc_id": b.column("doc_id").slice(rows.start, rows.stop - rows.start)}
                for k, c in zip(BASE_KINDS, counts, strict=True):
                    cols[c] = pa.array([sum(s[0] == k for s in base) for _, base, _ in found], pa.int64())
                cols["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for _, base, _ in found], pa.string())
                cols["spans"] = pa.array([joined(base + more) for _, base, more in found], pa.string())
                cols["n_spans"] = pa.array([len(base) + len(more) for _, base, more in found], pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(search, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans go under the first one's."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with personal data in `text` replaced; null texts stay null, other columns stay as they are."""
    field = field or default_field()

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, found in all_spans(b.column("text"), field):
                part = b.slice(rows.start, rows.stop - rows.start)
                null = part.column("text").is_null().to_pylist()
                clean = [None if gone else masked(t, base + more) for gone, (t, base, more) in zip(null, found, strict=True)]
                cols = [pa.array(clean, pa.string()) if n == "text" else part.column(n) for n in part.schema.names]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(redact, docs.schema)
