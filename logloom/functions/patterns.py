"""Line shapes and token shapes, in Java regex form.

Fixed values: results depend on these exact patterns. ``(?U)`` makes the word,
digit, blank and boundary classes cover all of Unicode; ``(?s)`` lets the message
part run over the Unicode line separators.
"""

# month, day, time, host, program, pid, message
SYSLOG = (
    r"(?sU)^(\w{3})\s+(\d{1,2})\s(\d{2}:\d{2}:\d{2})\s(\S+)\s"
    r"([^\[:]+?)(?:\[(\d+)\])?:\s(.*)$"
)

# date, time, level, component, message
SERVICING = (
    r"(?sU)^(\d{4}-\d{2}-\d{2})\s(\d{2}:\d{2}:\d{2})[,\d]*\s+(\w+)\s+(\S+)\s+(.*)$"
)

# start of a syslog line, used only when no whole line matched
SYSLOG_PREFIX = r"(?U)^\w{3}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}\s\S+\s"

# a date and time embedded in a message
STAMP = r"(?U)\d{4}/\d{1,2}/\d{1,2}:\d{2}:\d{2}:\d{2}"

# tokens that stand for a value rather than for text: bracketed, number, hex,
# IPv4, path, UUID, mail address, host name, mention, long hex digest
VARIABLE = (
    r"(?sU)^(?:<.*>|\d+|0x[0-9a-fA-F]+|(?:\d{1,3}\.){3}\d{1,3}|[/\\].*"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[^@\s]+@[^@\s]+\.[^@\s]+|[\w-]+\.\w{2,}|@.*|[0-9a-fA-F]{40,})$"
)

WILDCARD = "<*>"

# the same tokens inside a text whose words stand one blank apart
VARIABLE_WORD = (
    r"(?U)(?<![^ ])(?:<[^ ]*>|\d+|0x[0-9a-fA-F]+|(?:\d{1,3}\.){3}\d{1,3}|[/\\][^ ]*"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[^@ ]+@[^@ ]+\.[^@ ]+|[\w-]+\.\w{2,}|@[^ ]*|[0-9a-fA-F]{40,})(?![^ ])"
)

# blanks: Unicode white space and the four information separators
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = _BLANK + "+"
# the same except a single space, which already is what blanks are replaced by
UNEVEN_BLANKS = _BLANK + "{2,}|" + _BLANK.replace(r"\x20", r"\x1f")
# what is no printable ASCII, so all blanks but the space among others
NOT_PLAIN = r"[^ -~]"
# those blanks one by one: a search for each costs less than one by a pattern of all, which tests every letter against every range
ODD_BLANKS = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
OUTER_BLANKS = f"^{_BLANK}+|{_BLANK}+$"

# whole words that decide the severity of a message
ERROR_WORDS = ("ERROR", "FAILED", "FATAL", "ALERT", "CRITICAL")
ERROR_WORDS_LEGACY = ERROR_WORDS + ("E_FAIL",)
WARNING_WORDS = ("WARN", "WARNING")
INFO_WORDS = ("INFO", "INFORMATION")
FAILED_HRESULT = r"(?U)HRESULT\s*=\s*0x8[0-9a-fA-F]{7}"

# level names that a CSV level column may hold
KNOWN_LEVELS = ("info", "warning", "error", "debug", "trace", "fatal", "critical")

# words that settle the format when no line matched
SYSLOG_HINTS = ("sshd", "pam_unix", "su(")
SERVICING_HINTS = ("CBS", "TrustedInstaller")
