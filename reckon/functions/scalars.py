"""Scalar expressions on statements and ledgers. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

#: Date formats in the order in which they are tried.
DATE_FORMATS = ("d/M/yy", "d/M/yyyy", "d-MMM-yyyy", "d-MMM-yy", "yyyy-M-d", "d-M-yyyy", "d-M-yy", "d MMM yyyy", "d MMM yy", "d.M.yyyy")
_SHAPES = (r"\d{1,2}/\d{1,2}/\d{2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}-[A-Za-z]{3}-\d{4}", r"\d{1,2}-[A-Za-z]{3}-\d{2}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}-\d{1,2}-\d{2}", r"\d{1,2} [A-Za-z]{3} \d{4}", r"\d{1,2} [A-Za-z]{3} \d{2}", r"\d{1,2}\.\d{1,2}\.\d{4}")

#: Cities that end a card narration.
CITIES = "BANGALORE BENGALURU MUMBAI DELHI PUNE CHENNAI HYDERABAD GURGAON NOIDA KOLKATA BLR".split()
#: Legal and small words of names, and words without a brand.
SMALL_WORDS = ("of", "and", "the", "for")
LEGAL_WORDS = ("co", "pvt", "ltd", "llp", "inc")
NON_BRAND = "pvt ltd private limited llp inc india co corp corporation the and of &".split()
INTERNAL_REFERENCES = "^(PV-|RV-|SAL-|PC-|JV-)"


def parse_date(text: Column) -> Column:
    """The date in the first format that fits, else null. Two-digit years from 69 on are of the 1900s."""
    s = F.trim(text)
    parts = []
    for shape, fmt in zip(_SHAPES, DATE_FORMATS):
        value = F.initcap(F.regexp_replace(s, "-", " ")) if "MMM" in fmt else s
        date = F.try_to_date(value, fmt.replace("-", " ") if "MMM" in fmt else fmt)
        if not fmt.endswith("yyyy") and fmt.endswith("yy"):
            date = F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)
        parts.append(F.when(s.rlike(f"^{shape}$"), date))
    return F.coalesce(*parts)


def parse_money(text: Column) -> Column:
    """Signed amount of a money text: separators and currency signs dropped, brackets negative, DR and CR
    dropped without a change of sign, blank zero, anything else null; exact, two places, half up."""
    s = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r",|₹|Rs\.|Rs", "")
    s = F.trim(s)
    bracket = s.startswith("(") & s.endswith(")")
    s = F.when(bracket, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s)
    s = F.trim(F.regexp_replace(s, r"(?i) (DR|CR)$", ""))
    number = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s).try_cast("decimal(38,10)")
    value = F.round(F.when(bracket, -number).otherwise(number), 2).try_cast(MONEY)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0).cast(MONEY)).otherwise(value)


def signed_amount(amount: Column | None, debit: Column | None, credit: Column | None, day_book: bool, credit_negative: bool = False) -> Column:
    """Signed amount of a row from text columns. A blank amount falls back to debit and credit; a day book counts
    debits in, a statement credits in."""
    zero = F.lit("")
    d, c = F.abs(parse_money(debit if debit is not None else zero)), F.abs(parse_money(credit if credit is not None else zero))
    both = (d - c if day_book else c - d).cast(MONEY)
    if amount is None:
        return both
    own = parse_money(amount)
    own = -own if credit_negative else own
    return F.when(F.trim(F.coalesce(amount, zero)) != "", own).otherwise(both).cast(MONEY)


def half_up(x: Column, places: int = 2) -> Column:
    """Rounding of doubles with halves towards plus infinity."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / F.lit(f)


def month_start(period: Column) -> Column:
    return F.to_date(F.concat(period, F.lit("-01")))


def in_period(date: Column, period: Column) -> Column:
    start = month_start(period)
    return date.between(start, F.last_day(start))


def channel(narration: Column) -> Column:
    """Payment channel at the head of a narration, CLG counting as CHQ; null if none."""
    found = F.upper(F.regexp_extract(F.trim(narration), r"(?i)^(?:BULK\s+)?(NEFT|RTGS|UPI|NACH|IMPS|POS|CHQ|CLG)\b", 1))
    return F.when(found == "CLG", "CHQ").when(found != "", found)


def counterparty(narration: Column, bank_name: Column | None = None) -> Column:
    """The other party named in a narration."""
    bank = F.coalesce(bank_name, F.lit("Bank")) if bank_name is not None else F.lit("Bank")
    d = F.trim(narration)
    u = F.upper(d)
    ch = F.coalesce(channel(u), F.lit(""))
    dash = F.transform(F.split(d, "-"), F.trim)
    slash = F.split(d, "/")
    ifsc = F.upper(F.get(dash, F.lit(1))).rlike("^[A-Z]{4}0[A-Z0-9]{6}$")
    wire = F.when((F.size(dash) >= 3) & ifsc, F.get(dash, F.lit(2))).when(F.size(dash) >= 2, F.get(dash, F.lit(1)))
    words = F.filter(F.split(d, r"\s+"), lambda w: w != "")
    card = F.slice(words, 3, 1 << 20)
    city = (F.size(card) > 1) & F.upper(F.try_element_at(card, F.lit(-1))).isin(*CITIES)
    card = F.when(city, F.slice(card, F.lit(1), F.greatest(F.size(card) - 1, F.lit(0)))).otherwise(card)
    pos = F.array_join(card, " ")
    plain = F.array_join(F.slice(F.filter(F.split(d, r"[\s/\-]+"), lambda w: (w != "") & ~w.rlike(r"\d{4,}")), 1, 4), " ")
    generic = F.when(plain != "", plain).otherwise(d)
    return (
        F.when(u.rlike("^(CHRG|GST ON CHGS|.*ANNUAL FEE|SMS CHGS|NEFT/RTGS CHGS|MIN BAL CHGS)"), F.concat(bank, F.lit(" — charges")))
        .when(u.rlike(r"^(INT\.?PD|INT\.? CREDIT|INTEREST)"), F.concat(bank, F.lit(" — interest")))
        .when(u.rlike("^(CASH WDL|ATM WDL|CASH DEP)"), F.when(u.contains("WDL"), "ATM cash withdrawal").otherwise("Cash deposit"))
        .when(u.rlike("SALARY|PAYROLL") & (u.contains("BULK") | u.contains("BATCH")), "Payroll — Bulk salary")
        .when(ch.isin("NEFT", "RTGS") & wire.isNotNull(), wire)
        .when((ch == "UPI") & (F.size(slash) >= 3), F.get(slash, F.lit(2)))
        .when((ch == "IMPS") & (F.size(slash) >= 4), F.get(slash, F.lit(3)))
        .when((ch == "NACH") & (F.size(dash) >= 3), F.get(dash, F.lit(2)))
        .when(ch == "POS", F.when(pos != "", pos).otherwise(d))
        .when(ch == "CHQ", F.when(F.size(dash) >= 2, F.try_element_at(dash, F.lit(-1))).otherwise(d))
        .otherwise(generic)
    )


def _title(word: Column) -> Column:
    """A capital at each word boundary inside a word without spaces."""
    pieces = F.split(F.lower(word), r"(?<=\W)(?=\w)|(?<=\w)(?=\W)")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


def display_name(name: Column) -> Column:
    """Title case; small words lower, legal words capitalised, short or vowel-less acronyms kept."""

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        acronym = w.rlike(r"^[A-Z]+$") & ((F.length(w) <= 3) | ~w.rlike("[AEIOU]"))
        return F.when((i > 0) & low.isin(*SMALL_WORDS), low).when(low.isin(*LEGAL_WORDS), F.initcap(w)).when(acronym, w).otherwise(_title(w))

    return F.array_join(F.transform(F.filter(F.split(name, r"\s+"), lambda w: w != ""), one), " ")


def upi_handle(narration: Column) -> Column:
    """The brand in a UPI address, or null."""
    last = F.substring_index(narration, "/", -1)
    words = F.filter(F.split(F.substring_index(last, "@", 1), "[^A-Za-z]+"), lambda w: F.length(w) > 2)
    out = F.array_join(words, " ")
    return F.when((channel(narration) == "UPI") & narration.contains("@") & (out != ""), out)


def mask_numbers(text: Column) -> Column:
    """Account and card numbers hidden but for their last four characters."""
    parts = F.split(text, r"(?U)\b")
    hide = lambda w: F.when(w.rlike(r"^\d[\dX]{7,}\d{3,4}$"), F.concat(F.repeat(F.lit("X"), F.length(w) - 4), F.substring(w, -4, 4))).otherwise(w)
    return F.array_join(F.transform(parts, hide), "")


def normal_reference(text: Column) -> Column:
    """Upper-case letters and digits of a reference."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def initials(name: Column) -> Column:
    """Initials of a brand of at least two words, else empty."""
    words = F.filter(F.split(F.lower(name), "[^a-z&]+"), lambda w: (w != "") & ~w.isin(*NON_BRAND))
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).otherwise("")


def inr(amount: Column) -> Column:
    """Absolute amount in Indian grouping, as ₹1,24,500.00."""
    s = F.abs(amount.cast("decimal(38,2)")).cast("string")
    whole, rest = F.substring_index(s, ".", 1), F.substring_index(s, ".", -1)
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    return F.concat(F.lit("₹"), grouped, F.lit("."), rest)


def compact_money(amount: Column) -> Column:
    """Amount in crores, lakhs or thousands, as ₹1.25 L, with a minus sign if negative."""
    a = F.abs(amount.cast("double"))
    body = (
        F.when(a >= 1e7, F.format_string("%.2f Cr", a / 1e7)).when(a >= 1e5, F.format_string("%.2f L", a / 1e5))
        .when(a >= 1e3, F.format_string("%.1fK", a / 1e3)).otherwise(F.format_string("%.0f", a))
    )
    return F.concat(F.when(amount < 0, "\u2212").otherwise(""), F.lit("₹"), body)


def mentions(text: Column) -> Column:
    """People named by an at sign, first and last name, in a comment."""
    return F.regexp_extract_all(text, F.lit("@([A-Z][a-z]+ [A-Z][a-z]+)"), 1)
