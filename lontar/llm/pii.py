"""Operator 6, format-preserving Feistel pseudonyms for personal data, in DataFrame and SQL functions only.

Candidates are found by pattern and validated (Luhn, mod 97, octets, calendar, number plans). A valid value is
permuted within its own format by a keyed Feistel network: equal values get equal pseudonyms in every document,
different values of a format get different ones, and the pseudonym is valid in the same way as the value was.

- text-like values (the local part of an e-mail address, the bare digits of phone and card numbers, an IBAN's account
  without its blanks) go through ten rounds that shift each digit or letter of one half within its class by a keyed digest
  of the other; blanks, dots, dashes and brackets are put back afterwards, so that a number keeps its pseudonym however
  it is grouped; a single letter or digit is permuted within its class;
- numeric ones (IPv4 addresses, social security numbers, dates) are pairs in Z_a x Z_b, to whose halves a keyed digest
  of the other half is added in turn; check digits are computed again.

Results for odd input: a null text stays null and an empty one empty; values that don't validate stay; overlapping
candidates: the leftmost counts, then the kinds' order; repeated rows get equal rows; other columns are kept, whatever
their names (a count whose name a column has gets an underscore more). A very long text is one row's work: each value in
it is permuted by itself.

Plans hold a key that is derived from yours, after the mark ``pseudonym-key-``; whoever has it can make pseudonyms. Set
spark.sql.redaction.string.regex to ``pseudonym-key-[0-9a-f]+`` to keep it out of explained plans and event logs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm import names

ROUNDS = 10
# The formats, by kind.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}(?:-[0-9]{1,3})?|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9-])",
    "phone": r"(?<![0-9+(])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4})(?![0-9-])",
}
KINDS = tuple(PATTERNS)
_LEAD, _FROM_LEAD = "0123456789", "ÈÉÀÁÂÃÄÅÆÇ"  # a leading digit's own classes: 0-1 and 2-9


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value that it uses more than once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digest(key: str, kind: str, turn: str, half: str) -> str:
    return f"sha2(concat('{key}|{kind}|', {turn}, '|', {half}), 256)"


_CLASSES = ((48, 10), (97, 26), (65, 26), (192, 8), (200, 2))


def _shifted(text: str, digest: str) -> str:
    """Each character of text moved within its class by two hex digits of the digest."""
    by = "int(conv(substr(g, 1 + 2 * (j % 32), 2), 16, 10))"
    cases = " ".join(f"when ascii(c) between {a} and {a + n - 1} then chr({a} + (ascii(c) - {a} + {by}) % {n})" for a, n in _CLASSES)
    return _let("g", digest, f"array_join(transform(split({text}, ''), (c, j) -> case {cases} else c end), '')")


def _single(char: str, key: str, kind: str) -> str:
    """A single character's image: its class in the order of the characters' keyed digests."""
    order = lambda a, n: f"array_sort(transform(sequence({a}, {a + n - 1}), z -> named_struct('h', {_digest(key, kind, chr(39) + 'one' + chr(39), 'chr(z)')}, 'z', z)))"
    cases = " ".join(f"when ascii({char}) between {a} and {a + n - 1} then chr({order(a, n)}[ascii({char}) - {a}].z)" for a, n in _CLASSES)
    return f"case {cases} else {char} end"


def _text_feistel(value: str, key: str, kind: str) -> str:
    left = f"named_struct('l', {_shifted('a.l', _digest(key, kind, 'i', 'a.r'))}, 'r', a.r)"
    right = f"named_struct('l', a.l, 'r', {_shifted('a.r', _digest(key, kind, 'i', 'a.l'))})"
    network = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr(v, 1, length(v) div 2), 'r', substr(v, 1 + length(v) div 2)), (a, i) -> if(i % 2 = 0, {left}, {right}), a -> concat(a.l, a.r))"
    return _let("v", value, f"if(length(v) = 1, {_single('v', key, kind)}, {network})")


def _put_back(shape: str, signs: str, of: str = "c between '0' and '9'") -> str:
    """shape with its digits (or other signs) replaced by those of another text, in order."""
    step = f"if({of}, named_struct('o', concat(w.o, substr(s, w.k, 1)), 'k', w.k + 1), named_struct('o', concat(w.o, c), 'k', w.k))"
    return _let("s", signs, f"aggregate(split({shape}, ''), named_struct('o', '', 'k', 1), (w, c) -> {step}, w -> w.o)")


def _pair_feistel(left: str, right: str, a: int, b: int, key: str, kind: str) -> str:
    """A struct (l, r) of the pair's image in Z_a x Z_b."""
    number = lambda half: f"bigint(conv(substr({_digest(key, kind, 'i', half)}, 1, 12), 16, 10))"
    turn = f"if(i % 2 = 0, named_struct('l', (p.l + {number('p.r')}) % {a}, 'r', p.r), named_struct('l', p.l, 'r', (p.r + {number('p.l')}) % {b}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', bigint({left}), 'r', bigint({right})), (p, i) -> {turn})"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn_sum(digits: str, doubled: int) -> str:
    """The Luhn sum; doubled: the parity, from the right (0 for the last digit), of the digits that count twice."""
    two = "int(d) * 2 - if(int(d) > 4, 9, 0)"
    return f"aggregate(transform(split(reverse({digits}), ''), (d, j) -> if(j % 2 = {doubled}, {two}, int(d))), 0, (s, x) -> s + x)"


def _mod97(text: str) -> str:
    number = "if(c between '0' and '9', int(c), ascii(c) - 55)"
    return f"aggregate(split({text}, ''), 0, (m, c) -> (m * if(c between '0' and '9', 10, 100) + {number}) % 97)"


@dataclass(frozen=True)
class Pseudonyms:
    """The secret key, and the kinds of data to replace."""

    key: str = "replace-this-key"
    kinds: tuple[str, ...] = KINDS

    def __post_init__(self):
        if not self.key:
            raise ValueError("a key is needed")

    def pattern(self) -> str:
        return "|".join(f"(?:{PATTERNS[k]})" for k in self.kinds)

    def kind_of(self, x: str) -> str:
        """SQL for the kind of a candidate (null if it doesn't validate)."""
        octets = f"forall(split({x}, '[.]'), o -> o = string(int(o)) and int(o) < 256)"
        tests = {
            "email": f"{x} like '%@%'",
            "ipv4": f"{x} rlike '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' and {octets}",
            "ssn": f"{x} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$'",
            "date": f"{x} rlike '^[0-9]{{4}}-|^[0-9]{{2}}[/.]' and {self._day(x)} between 0 and 292193",
            "iban": f"{x} rlike '^[A-Z]{{2}}[0-9]{{2}}' and " + _let("t", f"replace({x}, ' ', '')", f"length(t) between 15 and 34 and {_mod97('concat(substr(t, 5), substr(t, 1, 4))')} = 1"),
            "card": f"{x} rlike '^[0-9]([ -]?[0-9]){{12,18}}$' and {_luhn_sum(_digits(x), 1)} % 10 = 0",
            "phone": f"{x} rlike '^([+]?1[ .-]?)?([(][0-9]{{3}}[)] ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}$' or {x} rlike '^[+][2-9]' and length({_digits(x)}) between 8 and 15",
        }
        return "case " + " ".join(f"when {test} then '{k}'" for k, test in tests.items() if k in self.kinds) + " end"

    @staticmethod
    def _day(x: str) -> str:
        """Days since 1600-01-01 of a date in one of the three formats (null if there is no such day); month first only where day first can't be."""
        y, a, b = f"substr({x}, -4)", f"substr({x}, 1, 2)", f"substr({x}, 4, 2)"
        iso = f"if({x} like '____-__-__', {x}, null)"
        day_first = f"if({x} like '____-__-__', null, concat({y}, '-', {b}, '-', {a}))"
        month_first = f"if({x} like '____-__-__', null, concat({y}, '-', {a}, '-', {b}))"
        return f"datediff(coalesce(try_to_date({iso}, 'yyyy-MM-dd'), try_to_date({day_first}, 'yyyy-MM-dd'), try_to_date({month_first}, 'yyyy-MM-dd')), date'1600-01-01')"

    def pseudonym(self, x: str) -> str:
        """SQL for a candidate's pseudonym (itself if it doesn't validate)."""
        key = "pseudonym-key-" + hashlib.sha256(self.key.encode()).hexdigest()
        local, domain = f"substring_index({x}, '@', 1)", f"substr({x}, instr({x}, '@'))"
        email = f"concat({_text_feistel(f'{local}', key, 'email')}, {domain})"
        octet = lambda k: f"int(split({x}, '[.]')[{k}])"
        ip = _let("q", _pair_feistel(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, key, "ipv4"), "concat_ws('.', q.l div 256, q.l % 256, q.r div 256, q.r % 256)")
        area, group, serial = f"int(substr({x}, 1, 3))", f"int(substr({x}, 5, 2))", f"int(substr({x}, 8, 4))"
        pair = _pair_feistel(f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1", f"{serial} - 1", 898 * 99, 9999, key, "ssn")
        ssn = _let("q", pair, "concat(lpad(string(q.l div 99 + 1 + if(q.l div 99 > 664, 1, 0)), 3, '0'), '-', lpad(string(q.l % 99 + 1), 2, '0'), '-', lpad(string(q.r + 1), 4, '0'))")
        pair = _let("n", self._day(x), _pair_feistel("n div 773", "n % 773", 378, 773, key, "date"))
        shape = f"case when {x} like '____-__-__' then 'yyyy-MM-dd' when {x} like '__/__/____' then if(try_to_date({x}, 'dd/MM/yyyy') is null, 'MM/dd/yyyy', 'dd/MM/yyyy') else if(try_to_date({x}, 'dd.MM.yyyy') is null, 'MM.dd.yyyy', 'dd.MM.yyyy') end"
        forms = " ".join(f"when '{f}' then date_format(m, '{f}')" for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "MM.dd.yyyy"))
        date = _let("m", f"date_add(date'1600-01-01', int({_let('q', pair, 'q.l * 773 + q.r')}))", f"case {shape} {forms} end")
        bare = f"replace({x}, ' ', '')"
        account = _let("t", f"concat(substr({bare}, 1, 2), '00', {_text_feistel(f'substr({bare}, 5)', key, 'iban')})", f"concat(substr(t, 1, 2), lpad(string(98 - {_mod97('concat(substr(t, 5), substr(t, 1, 4))')}), 2, '0'), substr(t, 5))")
        account = _put_back(x, account, "c <> ' '")
        inner = _let("t", f"concat(substr({_digits(x)}, 1, 1), {_text_feistel(f'substr({_digits(x)}, 2, length({_digits(x)}) - 2)', key, 'card')})", f"concat(t, string((10 - {_luhn_sum('t', 0)} % 10) % 10))")
        inner = _put_back(x, inner)
        lead = lambda d, k: f"translate(substr({d}, {k}, 1), '{_LEAD}', '{_FROM_LEAD}')"
        marked = f"concat({lead('d', 1)}, substr(d, 2, 2), {lead('d', 4)}, substr(d, 5))"
        ten = _let("d", f"right({_digits(x)}, 10)", f"translate({_text_feistel(marked, key, 'phone')}, '{_FROM_LEAD}', '{_LEAD}')")
        national = _put_back(x, f"concat(if(length({_digits(x)}) > 10, '1', ''), {ten})")
        abroad = _put_back(x, f"concat(substr({_digits(x)}, 1, 2), {_text_feistel(f'substr({_digits(x)}, 3)', key, 'phone')})")
        phone = f"if({x} rlike '^[+][2-9]', {abroad}, {national})"
        made = {"email": email, "ipv4": ip, "ssn": ssn, "date": date, "iban": account, "card": inner, "phone": phone}
        cases = " ".join(f"when '{k}' then {made[k]}" for k in self.kinds)
        return f"coalesce(case {self.kind_of(x)} {cases} end, {x})"


def pseudonymise(docs: DataFrame, rules: Pseudonyms = Pseudonyms(), counts: bool = False) -> DataFrame:
    """docs with ``text`` pseudonymised; counts: plus n_<kind>, the number of values replaced."""
    pattern, text = rules.pattern(), F.col("text").cast("string")
    found = F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    staged = names.plain(docs, found=found, gaps=F.when(text.rlike(pattern), F.split(text, pattern, -1)))
    new = F.concat(F.expr(f"transform(found, x -> {rules.pseudonym('x')})"), F.array(F.lit("")))
    at = f"c{next(i for i, c in enumerate(docs.columns) if c.lower() == 'text')}"
    joined = F.when(F.col("found").isNull(), F.col(at).cast("string")).otherwise(F.array_join(F.zip_with("gaps", new, lambda a, b: F.concat(a, b)), ""))
    columns = [joined.alias(c) if f"c{i}" == at else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    if counts:
        staged = staged.withColumn("kinds", F.expr(f"transform(found, x -> {rules.kind_of('x')})"))
        for k in rules.kinds:
            name = f"n_{k}"
            while name.lower() in {c.lower() for c in docs.columns}:
                name += "_"
            columns.append(F.expr(f"bigint(greatest(coalesce(size(filter(kinds, y -> y = '{k}')), 0), 0))").alias(name))
    return staged.select(*columns)
