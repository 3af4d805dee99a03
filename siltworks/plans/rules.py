"""Rules are data: tables of patterns that the match operators turn into projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from siltworks.functions import text


@dataclass(frozen=True)
class Pattern:
    regex: str
    negative: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    category: str
    patterns: tuple[Pattern, ...]
    languages: tuple[str, ...] = ("*",)
    priority: int = 3
    enabled: bool = True
    cwe: tuple[str, ...] = field(default=())
    false_positives: tuple[str, ...] = field(default=())


#: A pack for prose: what the redaction chains look for, and licence lines.
CORPUS_PACK = (
    Rule("TXT001", "E-mail address", "medium", "privacy", (Pattern(text.EMAIL),)),
    Rule("TXT002", "IPv4 address", "low", "privacy", (Pattern(text.IPV4),)),
    Rule("TXT003", "Long token", "high", "secrets", (Pattern(text.LONG_TOKEN),)),
    Rule("TXT004", "Key with a value", "critical", "secrets", (Pattern(text.KEY_VALUE),)),
    Rule("TXT005", "Licence line", "info", "legal", (Pattern(r"(?i)licen[sc]ed? under[^\n]*|under the [A-Za-z0-9 .-]+ licen[sc]e"),)),
)

# The built-in rules; (?i) and (?s) are the patterns' flags.
BUILT_IN = (
    Rule("SEC001", "SQL Injection", "critical", "injection", (
        Pattern(r"(?i)(?:query|execute|exec|raw)\s*\(\s*(?:['\"`].*\$\{|.*\+\s*(?:req|request|params|query|body|input))", ("PreparedStatement", "parameterized", r"\$\d+", r"\?")),
        Pattern(r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC).*\+.*(?:req|request|params|query|body|input|user)", ("PreparedStatement", "parameterized")),
        Pattern(r"(?i)\.(?:query|execute)\(\s*['\"`].*['\"`]\s*\+"),
        Pattern(r"(?i)f[\"'](?:SELECT|INSERT|UPDATE|DELETE).*\{.*\}"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby", "go"), 1, True, ("CWE-89",)),
    Rule("SEC002", "Cross-Site Scripting (XSS)", "high", "injection", (
        Pattern(r"(?i)innerHTML\s*=\s*(?!['\"`][^$]*['\"`])", ("DOMPurify", "sanitize", "escape")),
        Pattern(r"(?i)document\.write\s*\("),
        Pattern(r"(?i)\$\(.*\)\.html\s*\((?!['\"`][^$]*['\"`])"),
        Pattern(r"(?i)dangerouslySetInnerHTML\s*=", ("DOMPurify", "sanitize")),
        Pattern(r"(?i)v-html\s*="),
        Pattern(r"(?i)\{\{\{.*\}\}\}"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby"), 2, True, ("CWE-79",)),
    Rule("SEC003", "Command Injection", "critical", "injection", (
        Pattern(r"(?i)(?:exec|spawn|execSync|spawnSync|execFile)\s*\([^)]*(?:req|request|params|query|body|input|user)", (r"shell:\s*false",)),
        Pattern(r"(?i)child_process.*(?:exec|spawn)\s*\(\s*(?!['\"`][^$]*['\"`])"),
        Pattern(r"(?i)os\.system\s*\(\s*(?:f['\"]|['\"].*\+)"),
        Pattern(r"(?i)subprocess\.(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True"),
        Pattern(r"(?i)Runtime\.getRuntime\(\)\.exec\s*\("),
    ), ("javascript", "typescript", "python", "java", "ruby", "php", "go"), 1, True, ("CWE-78",)),
    Rule("SEC004", "Path Traversal", "high", "injection", (
        Pattern(r"(?i)(?:readFile|writeFile|readFileSync|writeFileSync|createReadStream|createWriteStream|open)\s*\([^)]*(?:req|request|params|query|body|input|user)", (r"path\.resolve", r"path\.join.*__dirname", "realpath")),
        Pattern(r"(?i)fs\..*\(\s*(?!['\"`][^$]*['\"`]).*(?:req|params|query)"),
        Pattern(r"(?i)open\s*\(\s*(?:f['\"]|['\"].*\+)", (r"os\.path\.abspath", r"os\.path\.realpath")),
        Pattern(r"(?i)new\s+File\s*\([^)]*(?:request|params|input)"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby", "go"), 2, True, ("CWE-22",)),
    Rule("SEC005", "Hardcoded Credentials", "high", "secrets", (
        Pattern(r"(?i)(?:password|passwd|pwd|secret|api_?key|apikey|auth_?token|access_?token|private_?key)\s*[:=]\s*['\"`][^'\"`]{8,}['\"`]", (r"process\.env", r"os\.environ", "getenv", r"config\.", "placeholder", "example", "xxx", r"\*\*\*")),
        Pattern(r"(?i)(?:AWS|AZURE|GCP|GOOGLE).*(?:KEY|SECRET|TOKEN)\s*[:=]\s*['\"`][A-Za-z0-9+/=]{20,}['\"`]"),
        Pattern(r"(?i)-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----"),
        Pattern(r"ghp_[a-zA-Z0-9]{36}"),
        Pattern(r"sk-[a-zA-Z0-9]{48}"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby", "go", "rust"), 1, True, ("CWE-798",)),
    Rule("SEC006", "Insecure Deserialization", "critical", "injection", (
        Pattern(r"(?i)(?:pickle|cPickle)\.(?:loads?|Unpickler)\s*\("),
        Pattern(r"(?i)yaml\.(?:load|unsafe_load)\s*\(", (r"Loader\s*=\s*yaml\.SafeLoader",)),
        Pattern(r"(?i)unserialize\s*\(\s*\$"),
        Pattern(r"(?i)ObjectInputStream.*readObject\s*\("),
        Pattern(r"(?i)Marshal\.load\s*\("),
        Pattern(r"(?i)eval\s*\(\s*(?:JSON\.parse|atob)"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby"), 1, True, ("CWE-502",)),
    Rule("SEC007", "XML External Entity (XXE)", "high", "injection", (
        Pattern(r"(?i)(?:parseString|parseXML|DOMParser|XMLReader)\s*\("),
        Pattern(r"(?is)DocumentBuilderFactory(?:(?!setFeature).)*\.newDocumentBuilder"),
        Pattern(r"(?is)XMLInputFactory(?:(?!setProperty).)*\.createXMLStreamReader"),
        Pattern(r"(?i)etree\.(?:parse|fromstring)\s*\(", ("defusedxml",)),
    ), ("javascript", "typescript", "python", "java", "csharp", "php"), 2, True, ("CWE-611",)),
    Rule("SEC008", "Server-Side Request Forgery (SSRF)", "high", "injection", (
        Pattern(r"(?i)(?:fetch|axios|request|http\.get|urllib|requests\.get)\s*\([^)]*(?:req|request|params|query|body|input|user|url)", ("allowlist", "whitelist", "validateUrl")),
        Pattern(r"(?i)new\s+URL\s*\([^)]*(?:req|request|params|query|input)"),
        Pattern(r"(?i)curl_(?:exec|init)\s*\("),
        Pattern(r"(?i)HttpClient.*(?:GetAsync|PostAsync|SendAsync)\s*\([^)]*(?:request|input|user)"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby", "go"), 2, True, ("CWE-918",)),
    Rule("SEC009", "Weak Cryptography", "medium", "cryptography", (
        Pattern(r"(?i)(?:createHash|hashlib|MessageDigest|Hash).*['\"`](?:md5|sha1|md4|md2)['\"`]"),
        Pattern(r"(?i)(?:createCipher|Cipher).*['\"`](?:des|rc4|rc2|blowfish)['\"`]"),
        Pattern(r"(?i)(?:RSA|DSA).*(?:1024|512)"),
        Pattern(r"(?i)Math\.random\s*\(\)"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby", "go"), 3, True, ("CWE-327", "CWE-328")),
    Rule("SEC010", "NoSQL Injection", "critical", "injection", (
        Pattern(r"(?i)(?:find|findOne|updateOne|updateMany|deleteOne|deleteMany|aggregate)\s*\(\s*\{[^}]*(?:\$where|\$regex|\$ne|\$gt|\$lt).*(?:req|request|params|body|query|input)"),
        Pattern(r"(?i)\$where.*(?:function|=>)"),
        Pattern(r"(?i)(?:collection|db)\.[^(]+\([^)]*(?:req\.body|req\.query|req\.params)", ("sanitize", "validate", "escape")),
    ), ("javascript", "typescript", "python", "java", "ruby", "php"), 1, True, ("CWE-943",)),
    Rule("SEC011", "Prototype Pollution", "high", "injection", (
        Pattern(r"(?i)(?:Object\.assign|\.\.\.)\s*\([^)]*(?:req|request|params|body|query|input)"),
        Pattern(r"(?i)(?:merge|extend|deepMerge|assign)\s*\([^)]*(?:req|request|params|body|query|input)", (r"\{\}\s*,",)),
        Pattern(r"(?i)\[(?:req|request|params|body|query|input)[^\]]*\]\s*="),
        Pattern(r"(?i)__proto__|constructor\.prototype"),
    ), ("javascript", "typescript"), 2, True, ("CWE-1321",)),
    Rule("SEC012", "Insecure Random Number Generation", "medium", "cryptography", (
        Pattern(r"(?i)Math\.random\s*\(\)"),
        Pattern(r"(?i)random\.(?:random|randint|choice)\s*\(", (r"secrets\.",)),
        Pattern(r"(?i)new\s+Random\s*\(\)"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby", "go"), 3, True, ("CWE-330",)),
    Rule("SEC013", "Open Redirect", "medium", "injection", (
        Pattern(r"(?i)(?:res\.redirect|response\.redirect|redirect_to|Location\s*:)\s*\(?[^)]*(?:req|request|params|query|body|input)", ("validateUrl", "allowedDomains", "whitelist")),
        Pattern(r"(?i)window\.location(?:\.href)?\s*=\s*(?!['\"`](?:https?:\/\/[^'\"`]+)?['\"`])"),
        Pattern(r"(?i)header\s*\(\s*['\"`]Location:.*\$"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "ruby", "go"), 3, True, ("CWE-601",)),
    Rule("SEC014", "Missing Authentication Check", "high", "authentication", (
        Pattern(r"(?i)(?:app|router)\s*\.(?:get|post|put|delete|patch)\s*\(\s*['\"`]\/(?:admin|api|dashboard|user|account|settings|profile)", ("auth", "authenticate", "requireAuth", "isAuthenticated", "passport", "jwt", "session")),
        Pattern(r"(?i)@(?:Get|Post|Put|Delete|Patch)Mapping.*(?:admin|user|account|settings)", ("@PreAuthorize", "@Secured", "@RolesAllowed")),
    ), ("javascript", "typescript", "python", "java", "php", "ruby"), 2, True, ("CWE-306",)),
    Rule("SEC015", "CORS Misconfiguration", "medium", "configuration", (
        Pattern(r"(?i)(?:Access-Control-Allow-Origin|origin)\s*[:=]\s*['\"`]\*['\"`]"),
        Pattern(r"(?i)cors\s*\(\s*\{[^}]*origin\s*:\s*(?:true|\*|['\"`]\*['\"`])"),
        Pattern(r"(?is)Access-Control-Allow-Credentials.*true.*Access-Control-Allow-Origin.*\*"),
    ), ("javascript", "typescript", "python", "java", "csharp", "php", "go"), 3, True, ("CWE-942",)),
)

# Line rules for container build files.
CONTAINER_FILE = (
    Rule("IAC-D1", "Using latest tag", "medium", "dockerfile", (Pattern(r"(?i)^FROM\s+\S+:latest"),), cwe=("CWE-1188",)),
    Rule("IAC-D2", "Running as root", "high", "dockerfile", (Pattern(r"(?i)^USER\s+root\s*$"),), cwe=("CWE-250",)),
    Rule("IAC-D3", "ADD with remote URL", "high", "dockerfile", (Pattern(r"(?i)^ADD\s+http"),), cwe=("CWE-494",)),
    Rule("IAC-D4", "Copying entire context", "medium", "dockerfile", (Pattern(r"(?i)^COPY\s+\.\s+"),), cwe=("CWE-200",)),
    Rule("IAC-D5", "Installing recommended packages", "low", "dockerfile", (Pattern(r"(?i)apt-get\s+install(?!.*--no-install-recommends)"),), cwe=("CWE-1104",)),
    Rule("IAC-D6", "APT cache not cleaned", "low", "dockerfile", (Pattern(r"(?i)apt-get\s+(?!.*&& rm -rf /var/lib/apt/lists)"),), cwe=("CWE-1104",)),
    Rule("IAC-D7", "Secrets in environment variables", "critical", "dockerfile", (Pattern(r"(?i)^ENV\s+\w*(?:PASSWORD|SECRET|KEY|TOKEN)\s*="),), cwe=("CWE-798",)),
    Rule("IAC-D8", "SSH port exposed", "medium", "dockerfile", (Pattern(r"(?i)^EXPOSE\s+22\s*$"),), cwe=("CWE-284",)),
    Rule("IAC-D9", "Privileged flag usage", "critical", "dockerfile", (Pattern(r"(?i)--privileged"),), cwe=("CWE-250",)),
    Rule("IAC-D10", "Health check disabled", "low", "dockerfile", (Pattern(r"(?i)HEALTHCHECK\s+NONE"),), cwe=("CWE-778",)),
)


def _line_rules(kind: str, rows: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(f"IAC-{kind}-{i}", title, level, kind, (Pattern(f"(?i){regex}"),), cwe=(cwe,)) for i, (title, level, cwe, regex) in enumerate(rows, 1))


# Line rules. Patterns with a line feed can never match a line; they are kept as they are.
COMPOSE = _line_rules("docker-compose", (
    ("Privileged container", "critical", "CWE-250", r"privileged:\s*true"),
    ("Host network mode", "high", "CWE-284", r"network_mode:\s*[\"']?host"),
    ("Host PID namespace", "high", "CWE-284", r"pid:\s*[\"']?host"),
    ("All capabilities added", "critical", "CWE-250", r"cap_add:\s*\n\s*-\s*ALL"),
    ("Docker socket mounted", "critical", "CWE-250", r"/var/run/docker\.sock"),
    ("Secrets in environment", "high", "CWE-798", r"environment:\s*\n[^:]*(?:PASSWORD|SECRET|KEY|TOKEN):"),
    ("Port exposed to all interfaces", "medium", "CWE-284", r"ports:\s*\n\s*-\s*[\"']?\d+:\d+[\"']?"),
    ("Writable root filesystem", "low", "CWE-732", r"read_only:\s*false"),
))
TERRAFORM = _line_rules("terraform", (
    ("Security group open to world", "high", "CWE-284", r"cidr_blocks\s*=\s*\[\s*[\"']0\.0\.0\.0/0[\"']\s*\]"),
    ("Resource publicly accessible", "high", "CWE-284", r"publicly_accessible\s*=\s*true"),
    ("Encryption disabled", "high", "CWE-311", r"encrypted\s*=\s*false"),
    ("Key rotation disabled", "medium", "CWE-320", r"enable_key_rotation\s*=\s*false"),
    ("Empty logging configuration", "medium", "CWE-778", r"logging\s*\{\s*\}"),
    ("Final snapshot skipped", "low", "CWE-1188", r"skip_final_snapshot\s*=\s*true"),
    ("Hardcoded password", "critical", "CWE-798", r"password\s*=\s*[\"'][^\"']+[\"']"),
    ("Public S3 bucket", "high", "CWE-284", r"acl\s*=\s*[\"']public-read"),
    ("Versioning disabled", "medium", "CWE-1188", r"versioning\s*\{\s*enabled\s*=\s*false"),
))
CLOUDFORMATION = _line_rules("cloudformation", (
    ("Security group open to world", "high", "CWE-284", r"CidrIp:\s*[\"']?0\.0\.0\.0/0"),
    ("Resource publicly accessible", "high", "CWE-284", r"PubliclyAccessible:\s*[\"']?true"),
    ("Storage encryption disabled", "high", "CWE-311", r"StorageEncrypted:\s*[\"']?false"),
    ("Public S3 bucket", "high", "CWE-284", r"AccessControl:\s*[\"']?PublicRead"),
    ("S3 versioning suspended", "medium", "CWE-1188", r"VersioningConfiguration:\s*\n\s*Status:\s*[\"']?Suspended"),
    ("Using SSM secure parameter", "info", "CWE-798", r"\{\{resolve:ssm-secure:"),
))
# Matched from a line to the end of the file, near the line; the first rule of a line wins.
KUBERNETES = _line_rules("kubernetes", (
    ("Privileged container", "critical", "CWE-250", r"privileged:\s*true"),
    ("Running as root user", "high", "CWE-250", r"runAsUser:\s*0"),
    ("Privilege escalation allowed", "high", "CWE-250", r"allowPrivilegeEscalation:\s*true"),
    ("Host network namespace", "high", "CWE-284", r"hostNetwork:\s*true"),
    ("Host PID namespace", "high", "CWE-284", r"hostPID:\s*true"),
    ("Host IPC namespace", "high", "CWE-284", r"hostIPC:\s*true"),
    ("Dangerous capabilities added", "critical", "CWE-250", r"capabilities:\s*\n\s*add:\s*\n\s*-\s*(?:ALL|SYS_ADMIN)"),
    ("Writable root filesystem", "medium", "CWE-732", r"readOnlyRootFilesystem:\s*false"),
    ("Unencrypted Secret", "medium", "CWE-312", r"kind:\s*Secret[\s\S]*?stringData:"),
    ("Missing resource limits", "medium", "CWE-770", r"resources:\s*\n\s*limits:\s*\n\s*(?!.*cpu|memory)"),
    ("Service account token auto-mounted", "low", "CWE-732", r"automountServiceAccountToken:\s*true"),
))
LINE_RULES = {"dockerfile": CONTAINER_FILE, "docker-compose": COMPOSE, "terraform": TERRAFORM, "cloudformation": CLOUDFORMATION}
