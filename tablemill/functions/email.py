"""E-mail addresses: parts, names, role accounts and private domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.text import let, normal, title, trimmed

#: Local parts that belong to a function, not a person. Fixed values.
ROLES = (
    "info kontakt contact support help helpdesk kundtjanst kundservice service order orders bestallning faktura fakturor invoice ekonomi kassa admin "
    "administration webmaster postmaster hostmaster abuse security noreply no-reply donotreply mail email post brev hej hello hallo office kontor reception "
    "hr jobb jobs karriar rekrytering press media marknad marketing sales salj forsaljning styrelsen styrelse kansli expedition it drift teknik webb web "
    "nyhetsbrev newsletter"
).split()
#: Domains of private persons. Fixed values.
PRIVATE = (
    "gmail.com googlemail.com hotmail.com hotmail.se hotmail.co.uk outlook.com outlook.se live.se live.com msn.com yahoo.com yahoo.se icloud.com me.com mac.com "
    "aol.com protonmail.com proton.me pm.me gmx.com gmx.de telia.com telia.se comhem.se bredband.net bredband2.com tele2.se glocalnet.net spray.se passagen.se "
    "bahnhof.se home.se swipnet.se zoho.com yandex.ru mail.ru web.de"
).split()
#: Top-level domains of two labels. Fixed values.
TWO_LABELS = "co.uk org.uk ac.uk gov.uk co.jp co.nz co.za com.au net.au org.au com.br com.tr com.cn pp.se tv.se".split()
ADDRESS = r"(?U)^([^\s@]+)@([^\s@]+\.[^\s@]+)$"
TYPED = r"(?U)^[^\s@,;]+@[^\s@,;]+\.[a-zA-ZåäöÅÄÖ]{2,}$"


def is_email(c: Column | str) -> Column:
    return trimmed(normal(c)).rlike(TYPED)


def parse_email(c: Column | str, surname_first: bool = False) -> Column:
    """struct(local, domain, main, top, first, last, role, private); null if it is no address.

    Dots and underscores split the local part into names, a hyphen only if there is neither; trailing
    digits are dropped. Names need two parts at least, and a role account has none.
    """
    def split(v):
        domain = F.regexp_extract(v, ADDRESS, 2)
        two = F.substring_index(domain, ".", -2)
        local = F.regexp_extract(v, ADDRESS, 1)
        bare = F.regexp_replace(local, r"[._-]?\d+$", "")
        return F.struct(
            v.alias("v"), local.alias("local"), domain.alias("domain"), F.when(bare == "", local).otherwise(bare).alias("base"),
            F.when(two.isin(TWO_LABELS), two).otherwise(F.substring_index(domain, ".", -1)).alias("top"),
            F.regexp_replace(local, r"\d+$", "").isin(ROLES).alias("role"),
        )

    def named(x):
        parts = F.split(x["base"], F.when(x["base"].rlike("[._]"), "[._]+").otherwise("-"))
        return F.transform(F.filter(parts, lambda p: p != ""), title)

    def read(x):
        main = x["domain"].substr(F.lit(1), F.length(x["domain"]) - F.length(x["top"]) - 1)
        names = let(named(x), lambda n: F.when(~x["role"] & (F.size(n) >= 2), n))
        pick = lambda f: F.coalesce(let(names, f), F.lit(""))
        many = lambda n: F.array_join(F.slice(n, 2 if surname_first else 1, F.size(n) - 1), " ")
        return F.when(
            x["v"].rlike(ADDRESS),
            F.struct(
                x["local"].alias("local"), x["domain"].alias("domain"), F.substring_index(main, ".", -1).alias("main"), x["top"].alias("top"),
                pick(many).alias("first"), pick(lambda n: F.element_at(n, 1 if surname_first else -1)).alias("last"),
                x["role"].alias("role"), x["domain"].isin(PRIVATE).alias("private"),
            ),
        )

    return let(let(F.lower(trimmed(normal(c))), split), read)


FIELDS = ("first", "last", "full", "local", "domain", "main", "top")


def email_field(c: Column | str, field: str, surname_first: bool = False) -> Column:
    """One of FIELDS as text; null if it is no address."""
    full = lambda p: F.when(p.isNotNull(), F.concat_ws(" ", F.nullif(p["first"], F.lit("")), F.nullif(p["last"], F.lit(""))))
    return let(parse_email(c, surname_first), full) if field == "full" else parse_email(c, surname_first)[field]
