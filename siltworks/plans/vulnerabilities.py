"""Tables for vulnerabilities: patterns of false positives, safe code, keywords, accuracies. All fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FalsePositive:
    id: str
    regex: str
    types: tuple[str, ...]
    languages: tuple[str, ...]
    classification: str
    confidence: float
    suppress: bool
    reason: str
    context: str | None = None


# Fixed values, tried in this order; a regex ignores case.
FALSE_POSITIVES = (
    FalsePositive("fp-sql-jdbc-template", r"jdbcTemplate\s*\.\s*(?:query|queryForObject|update|execute)\s*\(", ("sql_injection", "SQL Injection", "A03:2021", "CWE-89"), ("java",), "Spring JdbcTemplate - Uses parameterized queries", 0.9, True, "Spring JdbcTemplate with ? placeholders is safe from SQL injection", r"\?\s*[,)]"),
    FalsePositive("fp-sql-prepared-statement", r"PreparedStatement|prepareStatement\s*\(", ("sql_injection", "SQL Injection", "CWE-89"), ("java",), "JDBC PreparedStatement - Safe parameterized query", 0.85, True, "PreparedStatement with parameter binding is safe", r"setString|setInt|setLong|setParameter"),
    FalsePositive("fp-sql-python-parameterized", r"cursor\.execute\s*\([^,]+,\s*[\(\[]", ("sql_injection", "SQL Injection", "CWE-89"), ("python",), "Python parameterized query - Safe", 0.85, True, "cursor.execute with tuple/list parameters is safe"),
    FalsePositive("fp-sql-sqlalchemy-orm", r"session\.query\s*\(|\.filter\s*\(\s*\w+\.\w+\s*==", ("sql_injection", "SQL Injection", "CWE-89"), ("python",), "SQLAlchemy ORM - Safe query", 0.8, True, "SQLAlchemy ORM queries use parameterized queries internally"),
    FalsePositive("fp-sql-print-statement", r"(?:print|console\.log|logger\.\w+|System\.out\.print)\s*\([^)]*(?:SELECT|INSERT|UPDATE|DELETE)", ("sql_injection", "SQL Injection", "CWE-89"), ("any",), "Logging/Debugging Statement", 0.95, True, "SQL query strings in log statements are not vulnerabilities"),
    FalsePositive("fp-eval-literal", r"ast\.literal_eval\s*\(", ("code_injection", "eval()", "CWE-95"), ("python",), "Safe literal evaluation - Only evaluates literals", 0.95, True, "ast.literal_eval only parses literal structures, not arbitrary code"),
    FalsePositive("fp-eval-json-parse", r"JSON\.parse\s*\(", ("code_injection", "eval()", "CWE-95"), ("javascript", "typescript"), "JSON parsing - Not code execution", 0.9, True, "JSON.parse does not execute code"),
    FalsePositive("fp-eval-settimeout-number", r"setTimeout\s*\(\s*\w+\s*,\s*\d+\s*\)", ("code_injection", "eval()", "CWE-95"), ("javascript", "typescript"), "setTimeout with function reference - Safe", 0.85, True, "setTimeout with function reference (not string) is safe"),
    FalsePositive("fp-cmd-subprocess-safe", r"subprocess\.(?:run|Popen|call)\s*\([^)]*shell\s*=\s*False", ("command_injection", "CWE-78", "OS Command Injection"), ("python",), "Safe subprocess call - shell disabled", 0.85, True, "subprocess with shell=False does not use shell interpolation"),
    FalsePositive("fp-cmd-subprocess-list", r"subprocess\.(?:run|Popen|call)\s*\(\s*\[", ("command_injection", "CWE-78", "OS Command Injection"), ("python",), "Safe subprocess call - List arguments", 0.75, False, "subprocess with list arguments avoids shell interpolation"),
    FalsePositive("fp-cmd-exec-static", r"""(?:exec|system|spawn)\s*\(\s*['"][^'"$`{}]+['"]\s*\)""", ("command_injection", "CWE-78"), ("any",), "Static command execution - Review recommended", 0.6, False, "Exec with static string may be safe but review recommended"),
    FalsePositive("fp-xss-textcontent", r"\.textContent\s*=", ("xss", "XSS", "Cross-Site Scripting", "CWE-79"), ("javascript", "typescript"), "Safe text assignment - textContent is XSS-safe", 0.95, True, "textContent does not interpret HTML"),
    FalsePositive("fp-xss-dompurify", r"DOMPurify\.sanitize\s*\(", ("xss", "XSS", "Cross-Site Scripting", "CWE-79"), ("javascript", "typescript"), "Sanitized HTML - DOMPurify applied", 0.9, True, "DOMPurify sanitizes HTML to prevent XSS"),
    FalsePositive("fp-xss-htmlspecialchars", r"htmlspecialchars\s*\(", ("xss", "XSS", "Cross-Site Scripting", "CWE-79"), ("php",), "Sanitized output - htmlspecialchars applied", 0.85, True, "htmlspecialchars escapes HTML special characters"),
    FalsePositive("fp-xss-escape-function", r"escape(?:Html|XML|JS)?\s*\(", ("xss", "XSS", "Cross-Site Scripting", "CWE-79"), ("any",), "Escaped output - May be safe", 0.7, False, "Escape function used - verify it applies to the right context"),
    FalsePositive("fp-path-resolve", r"(?:path\.resolve|os\.path\.realpath|Path\([^)]+\)\.resolve)\s*\(", ("path_traversal", "CWE-22", "Directory Traversal"), ("any",), "Path normalization - Mitigates traversal", 0.7, False, "Path resolution may help but complete mitigation should be verified"),
    FalsePositive("fp-path-static", r"""(?:readFile|writeFile|open)\s*\(\s*['"][^'"$`{}]+['"]\s*[,)]""", ("path_traversal", "CWE-22"), ("any",), "Static file path - No user input", 0.85, True, "Static file path with no dynamic components is safe"),
    FalsePositive("fp-cred-test", r"""(?:password|secret|api_key)\s*[:=]\s*['"](?:test|example|dummy|changeme|placeholder)['"]""", ("hardcoded_credentials", "CWE-798", "Hardcoded"), ("any",), "Test/Example credential - Not real", 0.8, False, "Appears to be a test/placeholder credential"),
    FalsePositive("fp-cred-env", r"""(?:process\.env|os\.environ|getenv|ENV)\[['"]\w+['"]\]""", ("hardcoded_credentials", "CWE-798"), ("any",), "Environment variable - Not hardcoded", 0.9, True, "Credentials from environment variables are not hardcoded", r"(?:password|secret|api_key|token)"),
)
TEST_FILE = r"(?:test|spec|mock|stub|fake|fixture)s?\.(?:ts|js|py|java)$"
EXAMPLE = r"(?:example|sample|demo|tutorial)"
COMMENT = r"^\s*(?://|#|/\*|\*|<!--)"

# Code that a type of vulnerability is often mistaken for (regex, types, language).
MISCLASSIFIED = (
    (r"jdbcTemplate\s*\.\s*(?:query|update|execute)", ("sql_injection", "SQL Injection"), "java"),
    (r"(?:print|console\.log|logger\.|System\.out\.print)", ("sql_injection", "SQL Injection"), "any"),
    (r"ast\.literal_eval", ("code_injection", "eval()", "Code Injection"), "python"),
    (r"subprocess\.(?:run|Popen|call)\s*\([^)]*shell\s*=\s*False", ("command_injection", "Command Injection"), "python"),
    (r"\.textContent\s*=", ("xss", "XSS", "Cross-Site Scripting"), "javascript"),
    (r"cursor\.execute\s*\([^,]+,\s*[\(\[]", ("sql_injection", "SQL Injection"), "python"),
    (r"Path\s*\([^)]+\)\.resolve\(\)", ("path_traversal", "Path Traversal"), "python"),
)
SUSPICIOUS = (r"print\s*\(", r"console\.\w+", r"logger\.", r"log\s*\(", r"\.textContent", r"literal_eval", r"shell\s*=\s*False")

# Safe code (regex, types, reduction).
SAFE = (
    (r"\?\s*(?:,|\))", ("sql_injection",), 0.7),
    (r":\w+", ("sql_injection",), 0.6),
    (r"\$\d+", ("sql_injection",), 0.7),
    (r"setString|setInt|setParameter", ("sql_injection",), 0.8),
    (r"PreparedStatement", ("sql_injection",), 0.85),
    (r"shell\s*=\s*False", ("command_injection",), 0.7),
    (r"subprocess\.(?:run|call|Popen)\s*\(\s*\[", ("command_injection",), 0.5),
    (r"\.textContent\s*=", ("xss",), 0.9),
    (r"encodeURIComponent", ("xss",), 0.6),
    (r"htmlspecialchars", ("xss",), 0.7),
    (r"DOMPurify\.sanitize", ("xss",), 0.85),
    (r"escape\s*\(", ("xss",), 0.5),
    (r"ast\.literal_eval", ("code_injection", "eval"), 0.9),
    (r"JSON\.parse", ("code_injection", "eval"), 0.7),
    (r"\.resolve\(\)", ("path_traversal",), 0.5),
    (r"realpath", ("path_traversal",), 0.6),
    (r"basename", ("path_traversal",), 0.5),
)
# Words around code of a kind.
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "WHERE", "FROM", "JOIN", "CREATE", "DROP", "ALTER", "UNION", "ORDER BY", "GROUP BY", "HAVING", "LIMIT", "OFFSET", "cursor", "query", "execute", "fetchall", "fetchone", "Connection", "Statement")
COMMAND_WORDS = ("exec", "spawn", "shell", "system", "popen", "subprocess", "child_process", "run", "Process", "Runtime", "cmd", "bash", "sh", "powershell", "terminal")
MARKUP_WORDS = ("innerHTML", "outerHTML", "document.write", "insertAdjacentHTML", "dangerouslySetInnerHTML", "v-html", "res.send", "res.render", "HttpResponse", "echo", "print", "render_template_string")
LOGGING = (r"\bconsole\.\w+\s*\(", r"\bprint\s*\(", r"\blogger\.\w+\s*\(", r"\blog\.\w+\s*\(", r"System\.out\.print", r"System\.err\.print", r"Debug\.", r"Trace\.")
# Past accuracy by type, in the order in which parts of names are tried.
ACCURACY = {
    "hardcoded_secret": 0.85, "hardcoded_credentials": 0.85, "weak_random": 0.8, "insecure_deserialization": 0.75, "sql_injection": 0.65,
    "command_injection": 0.6, "xss": 0.55, "path_traversal": 0.6, "ssrf": 0.65, "code_injection": 0.5, "eval": 0.45,
    "information_disclosure": 0.5, "security_misconfiguration": 0.5, "default": 0.55,
}
# The model's weights, and the words that tell of an exploit.
WEIGHTS = {"pattern": 0.15, "context": 0.35, "language": 0.15, "lines": 0.15, "history": 0.20}
EXPLOIT_WORDS = ("exploit", "poc", "metasploit", "nuclei", "burp")
