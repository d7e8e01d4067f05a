"""Policies that follow from a column's name alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.functions.policy import REDACT, TOKEN
from maskweave.functions.types import TEXT

# The words that decide a policy.
EMAIL_WORDS = ("email", "e_mail", "email_address")
PHONE_WORDS = ("phone", "mobile", "telephone")
CONTACT_SECRET_WORDS = ("ssn", "card_number", "password")
BIRTH_WORDS = ("dob", "birthdate", "birthday", "date_of_birth", "birth_date")
PAY_WORDS = ("salary", "wage", "wages", "income", "compensation", "pay_rate")
PERSON_WORDS = (
    "full_name", "first_name", "last_name", "given_name", "family_name", "surname", "middle_name",
    "fullname", "firstname", "lastname", "contact_name", "customer_name", "patient_name", "member_name",
    "owner_name", "holder_name", "cardholder_name", "recipient_name", "employee_name", "display_name", "nickname",
)
ADDRESS_WORDS = ("address", "street", "street_address", "postal_address", "home_address")
IBAN_WORDS = ("iban",)
SECRET_WORDS = (
    "key", "api_key", "apikey", "secret", "client_secret", "token", "access_token", "refresh_token",
    "password", "passwd", "password_hash", "hash", "salt", "private_key", "credential", "credentials",
    "otp", "pin",
)

# Words, policy and namespace, in the order they are tried.
CONTACT_RULES = (
    (EMAIL_WORDS, TOKEN, "email"),
    (PHONE_WORDS, TOKEN, "phone"),
    (CONTACT_SECRET_WORDS, REDACT, ""),
)
PERSONAL_RULES = (
    (BIRTH_WORDS, REDACT, ""),
    (PAY_WORDS, REDACT, ""),
    (PERSON_WORDS, TOKEN, "person_name"),
    (ADDRESS_WORDS, REDACT, ""),
    (IBAN_WORDS, TOKEN, "iban"),
)


def words_pattern(words: tuple[str, ...]) -> str:
    return f"(^|_)({'|'.join(words)})(_|$)"


def name_has(name: Column, words: tuple[str, ...]) -> Column:
    """Whether the name is one of the words, or holds one between underscores; case does not count."""
    return F.lower(name).rlike(words_pattern(words))


def _first_rule(name: Column, rules: tuple) -> Column:
    """Entry of the first rule that matches; null when none does."""
    none = F.lit(None).cast("struct<policy: string, namespace: string>")
    out = none
    for words, policy, namespace in reversed(rules):
        entry = F.struct(F.lit(policy).alias("policy"), F.lit(namespace).alias("namespace"))
        out = F.when(name_has(name, words), entry).otherwise(out)
    return out


def contact_rule(name: Column) -> Column:
    return _first_rule(name, CONTACT_RULES)


def personal_rule(name: Column) -> Column:
    return _first_rule(name, PERSONAL_RULES)


def secret_name(name: Column) -> Column:
    return name_has(name, SECRET_WORDS)


def token_if_text(entry: Column, family: Column) -> Column:
    """A token needs text to hash: on any other family it becomes redact."""
    redact = F.struct(F.lit(REDACT).alias("policy"), F.lit("").alias("namespace"))
    return F.when((entry["policy"] == TOKEN) & (family != TEXT), redact).otherwise(entry)
