"""Personal numbers, dates and addresses replaced by keyed pseudonyms of the same format."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import string
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame

#: for the registered query and tests; a user passes a secret of their own
DEMO_KEY = b"wordtrail demonstration key"
KINDS = ("email", "iban", "card", "phone", "ip", "ssn", "date")
#: patterns of other forms of a kind
ALSO = {"iban_small": "iban", "card_dots": "card", "ip_six": "ip"}

PATTERN = re.compile(r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![\w-]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
  | (?P<iban_small>(?<![A-Za-z0-9])[a-z]{2}\d{2}(?:[ ]?[a-z0-9]){11,30}(?![A-Za-z0-9]))
  | (?P<card_dots>(?<![\d.])\d{4}(?:\.\d{4}){3}(?!\.?\d))
  | (?P<ip_six>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]))
  | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))
  | (?P<date>(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]))
  | (?P<phone>(?<![\d(])(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,8}){1,4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-]))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<card>(?<!\d)(?<!\d[.,])\d(?:[ -]?\d){12,18}(?!\d))
""", re.X | re.A)


# fixed values: characters of an IBAN by country
IBAN_LENGTHS = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
#: fixed values: the usual groupings of card numbers, and the first digits that issuers have
CARD_FORMS = [(4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)]
ISSUERS = re.compile(r"4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[4-9]|30[0-5]|6")
GROUPS, MOST_OTHERS = re.compile(r"\d+(?:[ -]\d+){0,63}", re.A), 2
DIGIT_GOES_ON = re.compile(r"[ -]?\d", re.A)


class Permutation:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network, walked until it stays inside."""

    ROUNDS = 10

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, size: int, number: int, half: int, bits: int) -> int:
        seed = f"{tweak}|{size}|{number}|{half}".encode()
        inner = hashlib.blake2b(seed, key=hashlib.sha256(self.key).digest(), digest_size=32).digest()
        return int.from_bytes(hashlib.shake_256(inner).digest(-(-bits // 8)), "big") & ((1 << bits) - 1)

    def _once(self, value: int, size: int, tweak: str, back: bool) -> int:
        bits = max(1, -(-(size - 1).bit_length() // 2))
        left, right = value >> bits, value & ((1 << bits) - 1)
        for number in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, size, number, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, size, number, right, bits)
        return left << bits | right

    def __call__(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return value
        while True:
            value = self._once(value, size, tweak, back)
            if value < size:
                return value


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def check_digit(digits: str) -> str:
    return next(d for d in string.digits if luhn(digits + d))


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def refill(form: str, chars: str, letters: str) -> str:
    """``form`` with its letters and digits (those in ``letters``) replaced by ``chars`` in turn."""
    rest = iter(chars)
    return "".join(next(rest) if c in letters else c for c in form)


def _classes(text: str) -> list[str]:
    return [string.digits if c.isdigit() else string.ascii_uppercase if c.isupper() else string.ascii_lowercase for c in text]


def permute_characters(text: str, tweak: str, move: Permutation, back: bool) -> str:
    """Digits to digits, capitals to capitals, small letters to small letters, as one number."""
    sets = _classes(text)
    value, size = 0, 1
    for c, own in zip(text, sets):
        value, size = value * len(own) + own.index(c), size * len(own)
    form = "".join(s[0] for s in sets)
    value = move(value, size, f"{tweak}:{form}", back)
    out = []
    for own in reversed(sets):
        value, at = divmod(value, len(own))
        out.append(own[at])
    return "".join(reversed(out))


FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(text: str, move: Permutation, back: bool) -> str | None:
    """Two-digit parts stay two-digit; of parts written with one digit, each keeps its number of digits."""
    mark = next(c for c in "-/." if c in text)
    parts = text.split(mark)
    year, month, day = map(int, parts if mark == "-" else reversed(parts))
    month_first = mark == "/" and month > 12
    if month_first:
        month, day = day, month
    short = any(len(p) == 1 for p in parts)
    if short and any(len(p) == 2 and p[0] == "0" for p in parts):
        return None
    try:
        at = (date(year, month, day) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= at < DAYS:
        return None
    while True:  # until the new date is written as the old one is, and read in the same order
        moved = FIRST_DAY + timedelta(days=(at := move(at, DAYS, "date", back)))
        if month_first and moved.day <= 12:
            continue
        own = [moved.year, moved.month, moved.day] if mark == "-" else [moved.month, moved.day, moved.year] if month_first else [moved.day, moved.month, moved.year]
        if not short:
            return mark.join(f"{n:02d}" for n in own)
        if [len(str(n)) for n in own] == list(map(len, parts)):
            return mark.join(map(str, own))


def _ssn_number(digits: str) -> int | None:
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1


def pseudonym(kind: str, text: str, move: Permutation, back: bool = False) -> str | None:
    """The pseudonym, or None if the text is no valid value of its kind. ``back`` undoes it."""
    digits = "".join(filter(str.isdigit, text))
    if kind == "email":
        name, _, domain = text.partition("@")
        own = [c for c in name if c.isalnum()]
        return refill(name, permute_characters("".join(own), "email", move, back), string.ascii_letters + string.digits) + "@" + domain
    if kind == "iban_small":
        made = pseudonym("iban", text.upper(), move, back)
        return made and made.lower()
    if kind == "card_dots":
        made = text
        while (made := pseudonym("card", made, move, back)) is not None and not issued(made):
            pass
        return made if issued(text) else None
    if kind == "ip_six":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        capital, made = text.upper() == text and text.lower() != text, text
        while True:  # digits in their places, small or capital letters as before
            hexes = "".join(c for c in made if c != ":")
            moved = f"{move(int(hexes, 16), 16 ** len(hexes), 'ip6', back):0{len(hexes)}x}"
            made = refill(text, moved, string.hexdigits)
            if capital and made.upper() == made.lower():
                continue
            return made.upper() if capital else made
    if kind == "iban":
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = permute_characters(plain[4:], f"iban:{plain[:2]}", move, back)
        check = 98 - iban_rest(plain[:2] + "00" + body)
        return refill(text, f"{plain[:2]}{check:02d}{body}", string.ascii_uppercase + string.digits)
    if kind == "card":
        if not luhn(digits) or not int(digits):
            return None
        size = 10 ** (len(digits) - 1)
        body = f"{move(int(digits[:-1]), size, 'card', back):0{len(digits) - 1}d}"
        return refill(text, body + check_digit(body), string.digits)
    if kind == "phone":
        first = re.match(r"\+(\d+)", text)
        code = 0 if not first else len(first[1]) if len(first[1]) <= 3 else 1 if digits[0] in "17" else 2
        if first and not 8 <= len(digits) <= 15:
            return None
        rest = digits[code:]
        return refill(text, digits[:code] + f"{move(int(rest), 10 ** len(rest), 'phone', back):0{len(rest)}d}", string.digits)
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        value = move(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "ssn":
        value = _ssn_number(digits)
        if value is None:
            return None
        rest, serial = divmod(move(value, 898 * 99 * 9999, "ssn", back), 9999)
        area, group = divmod(rest, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
    return _date(text, move, back)


def _iban_end(text: str) -> int | None:
    """Where the IBAN that begins a match ends: after its country's length, at the end of a group."""
    size = IBAN_LENGTHS.get(text[:2].upper())
    if size is None:
        return len(text)
    ends = [i for i, c in enumerate(text, 1) if c != " "]
    if len(ends) < size or text[ends[size - 1]:ends[size - 1] + 1] not in ("", " "):
        return None
    return ends[size - 1]


def issued(number: str) -> bool:
    """Whether a card number's check digit is right and its first digits are an issuer's."""
    digits = re.sub("[ .-]", "", number)
    return bool(ISSUERS.match(digits)) and luhn(digits)


def find_cards(run: str, goes_on: bool) -> list[tuple[int, int]]:
    """Card numbers in a row of digit groups: any group of 13 to 19 digits, and the usual groupings
    under one separator. The latter count only if the row has at most two groups more and does
    not go on: in a longer row of numbers, one in some tens would look like a card by chance."""
    groups = [m.span() for m in re.finditer(r"[0-9]+", run)]
    whole, grouped, others, i = [], [], 0, 0
    while i < len(groups):
        start, end = groups[i]
        if 13 <= end - start <= 19 and issued(run[start:end]):
            whole.append((start, end))
            i += 1
            continue
        for form in CARD_FORMS:
            own = groups[i:i + len(form)]
            if tuple(b - a for a, b in own) == form and len({run[b] for _, b in own[:-1]}) == 1 and issued(run[start:own[-1][1]]):
                grouped.append((start, own[-1][1]))
                i += len(form)
                break
        else:
            others, i = others + 1, i + 1
    return sorted(whole + grouped) if others <= MOST_OTHERS and not goes_on else whole


def _cards(run: str, goes_on: bool, move: Permutation, back: bool) -> tuple[str, list[tuple[int, int]]]:
    """The row with its card numbers replaced, one after the other (last first on the way back).

    Each is walked on until the row shows the same cards again, so that the way back finds them.
    """
    cards = find_cards(run, goes_on)
    for start, end in reversed(cards) if back else cards:
        made = run[start:end]
        while True:
            made = pseudonym("card", made, move, back)
            new = run[:start] + made + run[end:]
            if issued(made) and find_cards(new, goes_on) == cards:
                run = new
                break
    return run, cards


def replace(text: str, move: Permutation, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if "@" not in text and not any(d in text for d in string.digits):
        return text, counts

    out, done, at, seen = [], 0, 0, 0
    while match := PATTERN.search(text, at):
        form, (start, end), made = match.lastgroup, match.span(), None
        kind, at = ALSO.get(form, form), end
        if form == "card":
            at = start + len(re.match(r"\d+", match[0])[0])  # the next group may begin a value of its own
            if start >= seen:  # else the row was looked at already
                run = GROUPS.match(text, start)[0]
                goes_on = DIGIT_GOES_ON.match(text, start + len(run)) is not None
                new, cards = _cards(run, goes_on, move, back)
                if cards:
                    counts["card"] += len(cards)
                    out += text[done:start], new[:cards[-1][1]]
                    done = at = start + cards[-1][1]
                else:
                    seen = start + (len(run) // 2 if goes_on else len(run))
            continue
        if kind == "iban":
            at = start + len(re.match("[A-Za-z0-9]+", match[0])[0])  # what follows may be a value of its own
            if size := _iban_end(match[0]):
                end = start + size
                made = pseudonym(form, text[start:end], move, back)
        else:
            made = pseudonym(form, match[0], move, back)
        if made is not None:
            counts[kind] += 1
            out += text[done:start], made
            done = at = end
            seen = 0
    return "".join(out) + text[done:], counts


def pseudonymise(docs: DataFrame, secret: bytes, text: str = "text", key: str = "doc_id", back: bool = False) -> DataFrame:
    """``key, text`` and the number of values of each kind (``n_email``, ``n_card``, ...), one row a row.

    A value is a card number with a right check digit, first digits of an issuer and a usual
    grouping (see ``find_cards`` for rows of numbers), an IBAN with a right check, a social security
    number of valid parts, a calendar date from 1900 to 2099, an IPv4 or IPv6 address, a telephone
    number or an e-mail address (of which the name is changed). Card numbers and IBANs are also
    found beside other numbers and words; slash dates are read day first, or else month first.
    Under one secret equal values of one form get equal pseudonyms in all documents (but for card
    numbers beside digits with which they could be taken for another one), and ``back`` restores
    them. A null text stays null.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches):
        move = Permutation(secret)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                new, n = (None, dict.fromkeys(KINDS, 0)) if t is None else replace(t, move, back)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *[pa.array([n[k] for n in counts], pa.int32()) for k in KINDS]],
                                             names=[key, "text", *[f"n_{k}" for k in KINDS]])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, text string, " + ", ".join(f"n_{k} int" for k in KINDS))
