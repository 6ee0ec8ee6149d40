"""Detection catalogs and lookup tables.

Everything below the "fixed values" comments has to equal the published values,
because match results, scores and remediation texts depend on them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """One secret pattern.

    `anchors` are lower-case literals; a line without any of them cannot match,
    so the regex is skipped there. `shape` is a cheaper regex that plays the same
    part where no literal exists, on lines of `least` characters or more. With neither,
    the regex runs on every line.
    """

    name: str
    pattern: str
    severity: str = "medium"
    confidence: float = 0.8
    description: str = ""
    remediation: str = ""
    pattern_type: str = "regex"
    anchors: tuple[str, ...] = ()
    shape: str = ""
    least: int = 0

    @property
    def groups(self) -> int:
        return re.compile(self.pattern).groups

    def secret_group(self, mode: str = "reference") -> int:
        """Group reported as the secret: the first one, or with mode 'value' the last one."""
        return min(1, self.groups) if mode == "reference" else self.groups


_ROTATE_AWS = "Rotate AWS credentials immediately and use IAM roles or environment variables"
_KEY_STORAGE = "Remove private keys from code and use secure key storage"

# Built-in patterns.
BUILTIN_PATTERNS = (
    Pattern("AWS Access Key ID", r"AKIA[0-9A-Z]{16}", "critical", 0.9,
            "AWS Access Key ID detected", _ROTATE_AWS, anchors=("akia",)),
    Pattern("AWS Secret Access Key",
            r"""aws_secret_access_key\s*=\s*["']?([A-Za-z0-9+/]{40})["']?""", "critical", 0.95,
            "AWS Secret Access Key detected", _ROTATE_AWS, anchors=("aws_secret_access_key",)),
    Pattern("Generic API Key",
            r"""(?i)(api[_-]?key|apikey|api[_-]?secret)\s*[=:]\s*["']?([A-Za-z0-9_\-]{20,})["']?""",
            "high", 0.8, "Generic API key detected",
            "Move API keys to environment variables or secure key management", anchors=("api",)),
    Pattern("Database URL with Password",
            r"(?i)(mysql|postgresql|mongodb|redis)://[^:]+:([^@]+)@[^/]+", "high", 0.9,
            "Database connection string with embedded password",
            "Use environment variables for database credentials",
            anchors=("mysql://", "postgresql://", "mongodb://", "redis://")),
    Pattern("JWT Token", r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*", "medium", 0.85,
            "JWT token detected", "Ensure JWT tokens are not hardcoded and have proper expiration",
            anchors=(".eyj",)),
    Pattern("RSA Private Key", r"-----BEGIN RSA PRIVATE KEY-----", "critical", 1.0,
            "RSA private key detected", _KEY_STORAGE, anchors=("-----begin rsa private key-----",)),
    Pattern("SSH Private Key", r"-----BEGIN OPENSSH PRIVATE KEY-----", "critical", 1.0,
            "SSH private key detected", _KEY_STORAGE,
            anchors=("-----begin openssh private key-----",)),
    Pattern("GitHub Token", r"ghp_[A-Za-z0-9]{36}", "high", 0.95,
            "GitHub personal access token detected", "Revoke token and use GitHub secrets for CI/CD",
            anchors=("ghp_",)),
    Pattern("Slack Token", r"xox[baprs]-[A-Za-z0-9-]{10,}", "medium", 0.9,
            "Slack token detected", "Revoke token and use environment variables", anchors=("xox",)),
    Pattern("Password Assignment",
            r"""(?i)(password|passwd|pwd)\s*[=:]\s*["']([^"']{8,})["']""", "medium", 0.7,
            "Hardcoded password detected",
            "Use environment variables or secure configuration management",
            anchors=("password", "passwd", "pwd")),
)

# Organisation patterns, off by default.
CUSTOM_PATTERNS = (
    Pattern("Custom API Key Pattern",
            r"""(?i)(custom[_-]?api[_-]?key|customkey)\s*[=:]\s*["']?([A-Za-z0-9_\-]{32,})["']?""",
            "high", 0.85, "Custom organization API key detected",
            "Move API keys to environment variables or secure key management system",
            anchors=("custom",)),
    Pattern("Internal Service Token",
            r"""(?i)(service[_-]?token|svc[_-]?token)\s*[=:]\s*["']?([A-Za-z0-9_\-]{20,})["']?""",
            "medium", 0.8, "Internal service token detected",
            "Use secure token management and rotation policies", anchors=("token",)),
    Pattern("Custom Database Connection",
            r"""(?i)(db[_-]?connection|database[_-]?url)\s*[=:]\s*["']?([^"'\s]+://[^"'\s]+)["']?""",
            "high", 0.9, "Database connection string with potential credentials",
            "Use environment variables for database credentials", anchors=("://",)),
    Pattern("LDAP Bind Password",
            r"""(?i)(ldap[_-]?bind[_-]?password|ldap[_-]?pwd)\s*[=:]\s*["']?([^"'\s]{8,})["']?""",
            "high", 0.9, "LDAP bind password detected",
            "Use secure credential storage for LDAP authentication", anchors=("ldap",)),
    Pattern("Encryption Key",
            r"""(?i)(encryption[_-]?key|encrypt[_-]?key|cipher[_-]?key)\s*[=:]\s*["']?([A-Za-z0-9+/]{32,})["']?""",
            "critical", 0.95, "Encryption key detected in code",
            "Store encryption keys in secure key management systems", anchors=("encrypt", "cipher")),
    Pattern("OAuth Client Secret",
            r"""(?i)(oauth[_-]?client[_-]?secret|client[_-]?secret)\s*[=:]\s*["']?([A-Za-z0-9_\-]{20,})["']?""",
            "high", 0.9, "OAuth client secret detected",
            "Store OAuth secrets securely and rotate regularly", anchors=("client",)),
    Pattern("Webhook URL with Token", r"https://hooks\.[^/]+/[^/]+/[A-Za-z0-9]{20,}", "medium", 0.8,
            "Webhook URL with embedded token", "Use environment variables for webhook URLs",
            anchors=("https://hooks.",)),
    Pattern("Azure Storage Key",
            r"""(?i)(azure[_-]?storage[_-]?key|storage[_-]?account[_-]?key)\s*[=:]\s*["']?([A-Za-z0-9+/]{88}==)["']?""",
            "critical", 0.95, "Azure storage account key detected",
            "Use Azure Key Vault for storage keys", anchors=("storage",)),
    Pattern("GCP Service Account Key", r'"type":\s*"service_account"', "critical", 0.9,
            "Google Cloud service account key file detected",
            "Remove service account keys from code and use workload identity",
            anchors=('"service_account"',)),
    Pattern("SSH Private Key (ECDSA)", r"-----BEGIN EC PRIVATE KEY-----", "critical", 1.0,
            "ECDSA SSH private key detected", _KEY_STORAGE,
            anchors=("-----begin ec private key-----",)),
    Pattern("SSH Private Key (Ed25519)", r"-----BEGIN OPENSSH PRIVATE KEY-----", "critical", 1.0,
            "Ed25519 SSH private key detected", _KEY_STORAGE,
            anchors=("-----begin openssh private key-----",)),
    Pattern("Private Certificate Key", r"-----BEGIN PRIVATE KEY-----", "critical", 1.0,
            "Private certificate key detected", "Remove private certificates from code",
            anchors=("-----begin private key-----",)),
    Pattern("High Entropy Base64",
            r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?[A-Za-z0-9+/]{40,}",
            "medium", 0.6, "Potential Base64 encoded secret",
            "Review if this is a hardcoded secret that should be externalized",
            shape=r"[A-Za-z0-9+/]{40}", least=40),
    Pattern("Config Password",
            r"""(?i)(config[_-]?password|cfg[_-]?pwd)\s*[=:]\s*["']?([^"'\s]{8,})["']?""",
            "medium", 0.7, "Configuration password detected",
            "Use environment variables for configuration passwords", anchors=("config", "cfg")),
    Pattern("JWT Token (Specific)", r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*",
            "medium", 0.85, "JWT token detected",
            "Ensure JWT tokens are not hardcoded and have proper expiration", anchors=("eyj",)),
)

# Pattern categories.
PATTERN_CATEGORIES = {
    "authentication": ("Custom API Key Pattern", "Internal Service Token", "OAuth Client Secret",
                       "LDAP Bind Password"),
    "cloud_services": ("Azure Storage Key", "GCP Service Account Key"),
    "cryptographic": ("Encryption Key", "Private Certificate Key", "SSH Private Key (ECDSA)",
                      "SSH Private Key (Ed25519)"),
    "database": ("Custom Database Connection",),
    "generic": ("High Entropy Base64", "Config Password", "JWT Token (Specific)"),
}

# Exclusion patterns.
EXCLUSIONS = (
    r"(?i)(test|example|sample|demo|placeholder)",
    r"(?i)(todo|fixme|xxx|yyy|zzz)",
    r"^[0-9]+$",
    r"^[a-zA-Z]+$",
)

# Entropy analysis.
ENTROPY_NAME = "High Entropy String"
ENTROPY_REMEDIATION = "Review if this high-entropy string is a secret that should be externalized"
ENTROPY_MIN_LENGTH = 20
ENTROPY_MIN_BITS = 4.5
ENTROPY_MIN_DISTINCT = 0.3
ENTROPY_STOP_WORDS = ("password", "secret", "key", "token", "api", "config", "test", "example")
ENTROPY_SHAPES = (
    r'"([^"]{20,})"',
    r"'([^']{20,})'",
    r"=\s*([A-Za-z0-9+/]{20,})",
    r":\s*([A-Za-z0-9+/]{20,})",
)

# File selection of the scanner.
MAX_FILE_BYTES = 10 * 1024 * 1024
SCAN_EXTENSIONS = (
    ".py", ".js", ".ts", ".java", ".php", ".rb", ".go", ".cs", ".cpp", ".c",
    ".json", ".xml", ".yaml", ".yml", ".properties", ".env", ".config",
    ".sh", ".bat", ".ps1", ".sql", ".md", ".txt", ".ini", ".conf",
)
SKIP_NAMES = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".pytest_cache", "venv", "env", ".env",
    "build", "dist", "target", "bin", "obj", ".idea", ".vscode", "logs", "tmp", "temp",
)

# File selection of the progress counter.
COUNT_SUFFIXES = (
    ".py", ".js", ".ts", ".java", ".php", ".rb", ".go", ".cs", ".cpp", ".c", ".h",
    ".json", ".xml", ".yaml", ".yml", ".properties", ".config", ".env", ".ini",
    ".sql", ".sh", ".bash", ".ps1", ".dockerfile", ".tf", ".tfvars",
)
COUNT_SKIP_DIRS = ("node_modules", "__pycache__", "target", "build", "dist", "vendor")

# Project profiling, in order of declaration.
PROFILE_SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv")
LANGUAGE_MARKERS = {
    "python": (".py", "requirements.txt", "setup.py", "pyproject.toml", "Pipfile"),
    "javascript": ("package.json", ".js", ".ts", ".jsx", ".tsx"),
    "java": (".java", "pom.xml", "build.gradle", ".gradle"),
    "php": (".php", "composer.json"),
    "ruby": (".rb", "Gemfile"),
    "go": (".go", "go.mod"),
    "csharp": (".cs", ".csproj", ".sln"),
    "cpp": (".cpp", ".c", ".h", ".hpp", "CMakeLists.txt"),
    "rust": (".rs", "Cargo.toml"),
    "swift": (".swift", "Package.swift"),
}
FRAMEWORK_MARKERS = {
    "react": ("package.json", "src/App.js", "src/App.tsx"),
    "angular": ("angular.json", "package.json"),
    "vue": ("vue.config.js", "package.json"),
    "django": ("manage.py", "settings.py"),
    "flask": ("app.py", "requirements.txt"),
    "spring": ("pom.xml", "src/main/java"),
    "express": ("package.json", "app.js", "server.js"),
    "laravel": ("artisan", "composer.json"),
    "rails": ("Gemfile", "config/application.rb"),
}

# Package managers and their root-level files.
MANAGER_FILES = {
    "npm": ("package.json", "package-lock.json", "yarn.lock"),
    "pip": ("requirements.txt", "Pipfile", "pyproject.toml", "setup.py"),
    "maven": ("pom.xml",),
    "gradle": ("build.gradle", "build.gradle.kts"),
}
SCANNED_MANAGERS = ("npm", "pip", "maven")

# Severity tables.
SEVERITIES = ("critical", "high", "medium", "low")
SEVERITY_CVSS = {"critical": 9.0, "high": 7.5, "moderate": 5.0, "medium": 5.0, "low": 2.5, "info": 1.0}

# History event titles.
EVENT_TITLES = {
    "created": "Finding Created",
    "status_change": "Status Changed",
    "comment_added": "Comment Added",
    "false_positive": "Marked False Positive",
    "resolved": "Resolved",
    "scan_detected": "Detected in Scan",
}

# Local vulnerability records for component enrichment.
KNOWN_VULNERABILITIES = (
    {
        "component": "lodash", "cve_id": "CVE-2021-23337", "affected_versions": ["<4.17.21"],
        "fixed_version": "4.17.21", "impact": "Command Injection via template compilation",
        "exploit_maturity": "Proof of Concept Available",
        "usage_patterns": ["/src/utils/helpers.js:15 - _.template() usage",
                           "/src/controllers/dataProcessor.js:8 - _.merge() usage",
                           "/src/middleware/validation.js:23 - _.pick() usage"],
    },
    {
        "component": "axios", "cve_id": "CVE-2022-1214", "affected_versions": ["<0.27.0"],
        "fixed_version": "1.6.2", "impact": "Server-Side Request Forgery (SSRF)",
        "exploit_maturity": "Functional Exploit Available",
        "usage_patterns": ["/src/services/apiClient.js:12 - axios.get() calls",
                           "/src/integrations/external.js:45 - axios.post() usage"],
    },
    {
        "component": "express", "cve_id": "CVE-2022-24999", "affected_versions": ["<4.18.2"],
        "fixed_version": "4.18.2", "impact": "Open Redirect vulnerability in res.redirect()",
        "exploit_maturity": "Active Exploitation Detected",
        "usage_patterns": ["/src/app.js:25 - Express app initialization",
                           "/src/routes/auth.js:67 - res.redirect() usage",
                           "/src/routes/api.js:12 - Route handlers"],
    },
)

# CVE record used when no detail row is known.
CVE_FALLBACK = {
    "description": "Vulnerability details from local database",
    "cvss_score": 7.5,
    "cvss_vector": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "published_date": "2024-01-15",
    "last_modified": "2024-01-20",
    "severity": "HIGH",
    "reference_prefix": "https://nvd.nist.gov/vuln/detail/",
}

# Recommendation templates per severity.
RECOMMENDATIONS = {
    "critical": ("CRITICAL", "Immediate remediation required",
                 "Address ", " critical vulnerabilities immediately"),
    "high": ("HIGH", "Schedule remediation within 48 hours",
             "Fix ", " high-priority security issues"),
    "medium": ("MEDIUM", "Plan remediation within 1 week",
               "Address ", " medium-priority issues"),
}
