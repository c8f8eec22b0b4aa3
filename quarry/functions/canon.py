"""Canonical forms of e-mail addresses, domains, phone numbers and company names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains of consumer mail.
FREEMAIL = ["gmail.com", "googlemail.com", "yahoo.com", "ymail.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com", "mac.com", "proton.me", "protonmail.com", "gmx.com", "mail.com", "zoho.com", "yandex.com", "pm.me"]
# Reserved and placeholder domains.
PLACEHOLDER = ["example.com", "example.org", "example.net", "example.edu", "test.com", "localhost", "invalid", "none.com", "noemail.com", "no-reply.com", "noreply.com"]
# Local parts of shared mailboxes.
ROLES = ["info", "sales", "support", "admin", "administrator", "contact", "hello", "help", "office", "team", "marketing", "billing", "accounts", "accounting", "finance", "hr", "jobs", "careers", "press", "media", "legal", "privacy", "security", "abuse", "postmaster", "webmaster", "noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "notifications", "notification", "newsletter", "enquiries", "inquiries", "service", "customerservice", "orders", "hi"]
# Public suffixes of two labels.
SUFFIXES = ["co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "asn.au", "id.au", "co.nz", "net.nz", "org.nz", "govt.nz", "ac.nz", "school.nz", "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "com.br", "net.br", "org.br", "gov.br", "co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in", "co.za", "net.za", "org.za", "gov.za", "com.mx", "com.sg", "com.hk", "com.cn", "com.tr", "com.ar", "com.tw", "com.my", "co.kr", "co.il", "co.id", "co.th", "com.pl", "com.ua", "com.ph", "com.vn"]
# Legal forms at the end of company names.
LEGAL = ["incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "llc", "l.l.c", "llp", "lllp", "lp", "plc", "gmbh", "ag", "sa", "s.a", "nv", "bv", "ab", "as", "oy", "pty", "pte", "srl", "spa", "kg", "kk", "holdings", "group"]
# Fields that hold the addresses of one's own people.
INTERNAL_FIELDS = ["assignee.email", "assignee_email", "creator.email", "creator_email", "actor.email", "actor_email", "user.email", "user_email", "subscriber.email", "subscriber_email", "reporter.email"]

DENIED = FREEMAIL + PLACEHOLDER


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def email(raw: Column) -> Column:
    """local@domain without a tag, or null if it is malformed, a shared mailbox or a consumer domain."""
    return let(strip(F.regexp_replace(ascii_lower(strip(raw)), "^mailto:", "")), _email)


def _email(s: Column) -> Column:
    local = F.substring_index(F.regexp_extract(s, "^([^@]+)@([^@]+)$", 1), "+", 1)
    domain = F.regexp_replace(F.regexp_extract(s, "^([^@]+)@([^@]+)$", 2), "^[.]+|[.]+$", "")
    ok = (local != "") & domain.contains(".") & ~domain.contains(" ") & ~local.isin(*ROLES) & ~domain.isin(*DENIED)
    return F.when(ok, F.concat(local, F.lit("@"), domain))


def host(raw: Column) -> Column:
    s = ascii_lower(strip(raw))
    s = F.regexp_replace(s, "^(.*?://|mailto:)", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^.*@", ""), "[/?#].*$", ""), "^(.+):[0-9]*$", "$1")
    return let(strip(F.regexp_replace(s, "^[.]+|[.]+$", "")), lambda h: F.when((h != "") & h.contains(".") & ~h.contains(" "), h))


def registrable(name: Column) -> Column:
    """The last two labels of a host, or three where the last two are a public suffix."""
    return let(F.filter(F.split(name, "[.]"), lambda x: x != ""), _registrable)


def _registrable(labels: Column) -> Column:
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(n >= 2, F.when(two.isin(*SUFFIXES) & (n >= 3), three).otherwise(two))


def domain(raw: Column) -> Column:
    return let(registrable(F.regexp_replace(host(raw), "^www[.]", "")), lambda name: F.when(~name.isin(*DENIED), name))


def phone(raw: Column) -> Column:
    trimmed = strip(raw)
    digits = F.regexp_replace(trimmed, "[^0-9]", "")
    plus = trimmed.startswith("+")
    abroad = ~plus & digits.startswith("00")
    digits = F.when(abroad, F.substr(digits, F.lit(3))).otherwise(digits)
    bare = ~plus & ~abroad & (F.length(digits) == 10)
    return F.when(F.length(digits) >= 8, F.concat(F.when(bare, F.lit("+1")).otherwise(F.lit("+")), digits))


def name(raw: Column) -> Column:
    """Lower-cased words without punctuation and without legal forms at the end; null if none is left."""
    words = F.trim(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]+", " "))
    legal = "|".join(x for x in LEGAL if "." not in x)
    left = F.regexp_replace(words, f"(^| )({legal})( ({legal}))*$", "")
    return F.when(left != "", left)


def namespace(source: Column, field: Column) -> Column:
    """Whose address a field holds: one's own people's, or a customer's."""
    internal = ascii_lower(field).isin(*INTERNAL_FIELDS) | (ascii_lower(source) == "linear")
    return F.when(internal, "internal_directory").otherwise("customer_contact")
