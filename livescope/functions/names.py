"""Names that mark test runs, generated classes and private members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class-name prefixes that mark a test runner.
TEST_RUNNERS = (
    "org.junit.", "junit.framework.", "junit.textui.", "org.testng.", "org.apache.maven.surefire.", "org.apache.maven.plugin.surefire.",
    "org.apache.maven.plugin.failsafe.", "org.apache.maven.surefire.booter.", "org.gradle.api.internal.tasks.testing.", "org.gradle.process.internal.worker.",
    "worker.org.gradle.", "com.intellij.rt.execution.junit.", "com.intellij.rt.junit.", "org.jetbrains.plugins.scala.testingSupport.",
    "org.apache.tools.ant.taskdefs.optional.junit.", "org.spockframework.", "org.scalatest.", "io.cucumber.", "net.serenitybdd.core.", "org.robolectric.",
    "org.mockito.", "org.easymock.", "org.powermock.", "org.springframework.boot.test.", "org.springframework.test.context.", "io.restassured.",
    "org.testcontainers.", "kotlin.test.", "io.kotest.",
)

# Parts of member names whose values are never shown.
DENIED_PARTS = (
    "password", "passwd", "pwd", "secret", "token", "apikey", "key", "credential", "authorization", "authorisation", "auth", "bearer", "cookie", "session",
    "signature", "salt", "hash", "otp", "pin", "cvv", "cvc", "card", "pan", "iban", "swift", "bic", "account", "acct", "routing", "ssn", "sin", "nin",
    "aadhaar", "aadhar", "pannumber", "passport", "licence", "license", "dob", "birth", "email", "mail", "phone", "mobile", "msisdn", "tel", "address",
    "addr", "postcode", "zip", "pincode", "latitude", "longitude", "lat", "lon", "geo", "name", "firstname", "lastname", "surname", "gender", "race",
    "religion", "salary", "income", "medical", "diagnosis", "health",
)


def test_markers(classes: Column, prefixes: Sequence[str] = TEST_RUNNERS, most: int = 8) -> Column:
    """The first loaded classes that belong to a test runner; a window with any is refused."""
    return F.slice(F.filter(classes, lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(c, p))), 1, most)


def denied_name(name: Column, allow: Sequence[str] = ()) -> Column:
    """Whether a member's value must not be shown: no name, or a denied part in it, unless allowed by its whole name."""
    bare = F.regexp_replace(name, "^(get(?=.)|is(?=.))", "")
    plain = F.lower(F.regexp_replace(bare, "[^A-Za-z0-9]", ""))
    denied = plain.rlike("|".join(DENIED_PARTS))
    return F.when(name.isNull() | (plain == ""), True).when(plain.isin(*allow), False).otherwise(denied)
