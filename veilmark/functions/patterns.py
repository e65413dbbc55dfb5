"""Fixed values of the detectors, the scrubber and the gates: patterns, word lists, ranks.

Patterns are written in the dialect RE2 and Java share. Java reads `\\b` over Unicode letters, RE2 over ASCII ones;
`java` gives a pattern the ASCII meaning, so both engines find the same.
"""

from __future__ import annotations

import re

BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def java(pattern: str) -> str:
    """The pattern for Spark: ASCII word boundaries. One half is enough where the other side is a word character."""
    pattern = re.sub(r"\\b(?=\\d|\[A-Z\]|\[0-9\]|[0-9A-Za-z]|\[6789\]|\(\?:\\d)", lambda m: _BEFORE, pattern)
    pattern = re.sub(r"(?<=\\d)\\b|(?<=\\d\{4\})\\b|(?<=\\d\{9\})\\b|(?<=\\d\{12\})\\b|(?<=\[A-Z\])\\b", lambda m: _AFTER, pattern)
    return pattern.replace(r"\b", BOUNDARY)


# What each kind of data looks like.
EMAIL = r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_INTERNATIONAL = r"\+[1-9]\d{0,2}[\s.-]?(?:\(?\d{1,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{3,5}(?:\s*(?:ext|x|ext.)\s*\d+)?"
PHONE_GROUPED = r"\b\d{3}[.\-]\d{3}[.\-]\d{4}\b"
PHONE_NORTH_AMERICA = r"\b\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?:\s*(?:ext|x|ext.)\s*\d+)?\b"
PHONE_INDIA = r"\b(?:\+?91[\-\s]?)?[6789]\d{9}\b"
PHONE = f"(?:{PHONE_INTERNATIONAL})|(?:{PHONE_GROUPED})|(?:{PHONE_NORTH_AMERICA})|(?:{PHONE_INDIA})"
AADHAAR = r"\b\d{4}[\s\-.]\d{4}[\s\-.]\d{4}\b"
AADHAAR_BARE = r"\b\d{12}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
NATIONAL_ID = f"{AADHAAR}|{SSN}|{PAN}"
NATIONAL_ID_DETECT = f"{AADHAAR}|{AADHAAR_BARE}|{PAN}|{SSN}"
CARD_SPACED = r"\b(?:\d{4}[\s-]){3}\d{4}\b"
CARD_LOOSE = r"\b(?:\d{4}[\s-]?){3}\d{4}\b"
CARD_BRANDS = (
    r"\b4[0-9]{12}(?:[0-9]{3})?\b",
    r"\b5[1-5][0-9]{14}\b",
    r"\b2[2-7][0-9]{14}\b",
    r"\b3[47][0-9]{13}\b",
    r"\b6(?:011|5[0-9]{2})[0-9]{12}\b",
    r"\b\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}\b",
    r"\b3[47]\d{2}[\s-]\d{6}[\s-]\d{5}\b",
)
API_KEY = r"\b(?:sk-[a-zA-Z0-9_\-]{20,}|AKIA[0-9A-Z]{16}|gh[posru]_[a-zA-Z0-9]{36,}|AIza[0-9A-Za-z\-_]{35})\b"
API_KEY_DETECT = (
    r"\bsk-[a-zA-Z0-9_\-]{20,}\b",
    r"\bsk-ant-[a-zA-Z0-9_\-]{20,}\b",
    r"\bAIza[0-9A-Za-z\-_]{35}\b",
    r"\b(?:gh[posru]|github_pat)_[a-zA-Z0-9_]{36,}\b",
    r"\bxox[baprs]-[0-9a-zA-Z\-]{10,}\b",
    r"\b[sr]k_(?:test|live)_[a-zA-Z0-9]{20,}\b",
    r"\b(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b",
    r"(?i:\bBearer\s+[a-zA-Z0-9_\-.~+/]{20,}\b)",
    r"\beyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b",
    r"(?i:\b(?:api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?token)\s*[:=]\s*[\"']?[a-zA-Z0-9_\-.~+/]{16,})",
)
API_KEY_ANY = "|".join(f"(?:{p})" for p in API_KEY_DETECT)
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
PRIVATE_KEY_BLOCK = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----(?s:.*?)-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
#: Secrets without a detector of their own to go by: private keys, and assignments to a secret's name (our specification).
SECRET = PRIVATE_KEY + r"|(?i:\b(?:session[_-]?id|session|secret|token|passw(?:or)?d)\s*[:=]\s*[\"']?[A-Za-z0-9_\-.~+/]{16,})"
URL_PHONE = r"(?:\+?[1-9]\d{0,2}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
SERVER_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SERVER_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"
SERVER_NATIONAL_ID = r"\b\d{4}[\s.-]?\d{4}[\s.-]?\d{4}\b|" + SSN + "|" + PAN
SERVER_URL_PARAM = r"(?i)[?&](?:token|access_token|auth|key|api_key|secret|password|pwd|session_id|jwt)=[^&\s]+"

# Words in ids, labels, placeholders and autocomplete hints.
PASSWORD_ID = ("password", "pwd", "passcode", "pin")
PASSWORD_LABEL = ("password", "passcode", "pin")
PASSWORD_NAME = ("password", "passwd", "pwd")
ID_LABEL = ("aadhaar", "ssn", "identity", "pan")
ID_ID = ("aadhaar", "pan")
SEMANTIC = ("address", "credit card", "debit card", "cvv", "dob", "date of birth")
API_KEY_FIELD = (
    "api_key", "apikey", "api-key", "access_key", "access-key", "secret_key", "secret-key", "token", "auth_token", "auth-token", "bearer", "authorization", "x-api-key", "client_secret", "client-secret",
)
CARD_FIELD = (
    "card_number", "card-number", "cardnumber", "cc_number", "cc-number", "ccnumber", "credit_card", "credit-card", "debit_card", "debit-card", "card_num", "pan", "payment_card", "cvv", "cvc",
    "security_code", "security-code", "card_cvv", "card_cvc", "exp_month", "exp_year", "card_exp", "card_expiry",
)
CARD_AUTOCOMPLETE = ("cc-number", "cc-csc", "cc-exp")
URL_PARAM = (
    "token", "page_token", "access_token", "auth_token", "refresh_token", "id_token", "api_key", "apikey", "key", "secret", "client_secret", "password", "passwd", "pwd", "auth", "authorization",
    "session", "session_id", "sid", "code", "auth_code", "verification_code", "sig", "signature", "pin", "otp", "credential",
)
URL_PARAM_PART = ("token", "secret", "password", "api_key", "apikey", "auth", "passwd", "credential")

# Ranks and defaults of regions.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
REDACTION_RANK = {"blur": 1, "mask": 2, "blackout": 3}
SEVERITY_OF = {
    "password": "critical", "secret": "critical", "api_key": "high", "credit_card": "high", "id": "high", "email": "medium", "phone": "medium", "face": "medium", "sensitive": "medium", "address": "low", "name": "low",
}
REDACTION_OF = {"password": "blackout", "secret": "blackout", "sensitive": "blackout", "face": "blur"}
KNOWN_TYPES = tuple(SEVERITY_OF)
REDACTED = "[REDACTED]"
