"""The seed catalog: failure modes that are known before a project has any history."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SeedMode:
    """``exceptions``: patterns for a class name, case as written. ``messages``: patterns for the message, line by line, in any case.
    ``words``: lower-case pieces of the message or the class. ``label`` and ``confidence`` are what the mode suggests."""

    key: str
    label: str
    confidence: float
    exceptions: tuple[str, ...] = ()
    messages: tuple[str, ...] = ()
    words: tuple[str, ...] = ()


# The modes in order of priority; the first whose rules fit decides.
SEED_MODES = (
    SeedMode("oom_java", "si", 0.8, exceptions=(r"java\.lang\.OutOfMemoryError", "^MemoryError$",), words=("outofmemoryerror", "gc overhead limit",)),
    SeedMode("oom_killed_container", "si", 0.85, messages=("exit code 137", "OOMKilled", r"Killed\s+process",), words=("oom-killed", "exit status 137",)),
    SeedMode("stack_overflow", "pb", 0.5, exceptions=(r"java\.lang\.StackOverflowError", "^RecursionError$",)),
    SeedMode("disk_full", "si", 0.9, messages=("[Nn]o space left on device", "DiskFull",), words=("disk quota exceeded",)),
    SeedMode("too_many_open_files", "si", 0.75, messages=("[Tt]oo many open files",), words=("emfile",)),
    SeedMode("conn_refused", "si", 0.75, exceptions=("ConnectException", "ConnectionRefusedError",), messages=("[Cc]onnection refused",)),
    SeedMode("conn_reset", "si", 0.7, messages=("[Cc]onnection reset by peer", "[Bb]roken pipe", "ECONNRESET",)),
    SeedMode("conn_timeout", "si", 0.65, exceptions=("SocketTimeoutException", "ReadTimeout(Error)?$", "ConnectTimeout",), messages=("[Tt]imed? ?out (waiting for )?connection", "read timed out",)),
    SeedMode("dns_resolution", "si", 0.85, exceptions=("UnknownHostException", "gaierror",), messages=("[Nn]ame or service not known", "getaddrinfo failed", "NXDOMAIN",)),
    SeedMode("tls_cert", "si", 0.8, exceptions=("SSLHandshakeException", "SSLError", "CertificateException",), messages=("certificate verify failed", "PKIX path building failed", "self[- ]signed certificate",)),
    SeedMode("port_in_use", "si", 0.8, exceptions=("BindException",), messages=("[Aa]ddress already in use", "EADDRINUSE",)),
    SeedMode("proxy_gateway", "si", 0.75, messages=("502 Bad Gateway", "504 Gateway Time-?out", "ProxyError",)),
    SeedMode("http_5xx", "si", 0.6, messages=(r"\b(HTTP|status( code)?)[ :=]*5\d\d\b", "Internal Server Error", "Service Unavailable",)),
    SeedMode("http_401_403", "ab", 0.55, messages=(r"\b(HTTP|status( code)?)[ :=]*40[13]\b", "Unauthorized", "Forbidden",)),
    SeedMode("http_404", "ab", 0.45, messages=(r"\b(HTTP|status( code)?)[ :=]*404\b", "Not Found",)),
    SeedMode("http_429", "si", 0.75, messages=(r"\b429\b", "[Rr]ate limit", "quota exceeded", "Too Many Requests",)),
    SeedMode("db_pool_exhausted", "si", 0.75, messages=("[Cc]onnection pool.*(exhaust|timeout)", "HikariPool.*timed? ?out", "too many clients already", "QueuePool limit",)),
    SeedMode("db_deadlock", "pb", 0.5, messages=("[Dd]eadlock (found|detected)", "LockAcquisitionException", "lock wait timeout exceeded", "could not obtain lock",)),
    SeedMode("db_conn_failed", "si", 0.75, exceptions=("SQLTransientConnectionException", "OperationalError",), messages=("(database|db).*(connection (refused|failed))", r"FATAL:\s+(the )?database", "password authentication failed",)),
    SeedMode("db_migration_failed", "si", 0.7, messages=("[Ff]lyway.*(failed|error)", "liquibase.*(failed|error)", "alembic.*(error|failed)", "migration.*failed",)),
    SeedMode("kafka_rabbit", "si", 0.75, messages=("kafka.*(timeout|not available|disconnect)", "TimeoutException.*kafka", "(rabbitmq|amqp).*(refused|unreachable|timeout)",), words=("broker not available", "leader not available",)),
    SeedMode("redis_conn", "si", 0.75, exceptions=("JedisConnectionException", "RedisConnectionError",), messages=("redis.*(refused|timeout|unreachable)", "MISCONF Redis",)),
    SeedMode("wd_stale_element", "ab", 0.8, exceptions=("StaleElementReferenceException",)),
    SeedMode("wd_no_such_element", "ab", 0.65, exceptions=("NoSuchElementException",), messages=("[Uu]nable to (locate|find) element",)),
    SeedMode("wd_not_interactable", "ab", 0.7, exceptions=("ElementNotInteractableException", "ElementClickInterceptedException",), messages=("element not interactable", "Other element would receive the click",)),
    SeedMode("wd_wait_timeout", "ab", 0.6, exceptions=(r"org\.openqa\.selenium\.TimeoutException", r"selenium\.common\.exceptions\.TimeoutException",), messages=("[Ee]xpected condition failed.*wait", r"Waited \d+ seconds for",)),
    SeedMode("wd_session", "si", 0.7, exceptions=("WebDriverException", "SessionNotCreatedException", "NoSuchSessionException",), messages=("invalid session id", "session deleted because of page crash", "chrome not reachable",)),
    SeedMode("wd_driver_mismatch", "si", 0.85, messages=("[Tt]his version of ChromeDriver only supports", "session not created.*version", "unsupported browser version",)),
    SeedMode("browser_console", "pb", 0.5, messages=("console error(s)? (found|detected)", "severe.*console", "js console.*error",)),
    SeedMode("assertion_java", "pb", 0.4, exceptions=(r"java\.lang\.AssertionError", r"org\.junit\.ComparisonFailure", "AssertionFailedError",), messages=("expected:.*but was",)),
    SeedMode("assertion_pytest", "pb", 0.4, exceptions=("^AssertionError$",), messages=(r"^assert\b", "AssertionError:",)),
    SeedMode("assertion_js", "pb", 0.4, messages=(r"expect\(.*\)\.to", r"expect\(received\)", r"AssertionError \[ERR_ASSERTION\]", "jest.*expect",), words=("expected value to be",)),
    SeedMode("snapshot_mismatch", "ab", 0.5, messages=("[Ss]napshot.*(mismatch|does not match|obsolete)", "toMatchSnapshot", "screenshot comparison failed", "pixel difference",)),
    SeedMode("soft_assert_bundle", "pb", 0.4, messages=("[Ss]oft ?assert", "The following asserts failed",)),
    SeedMode("npe_undefined", "pb", 0.55, exceptions=(r"java\.lang\.NullPointerException",), messages=("TypeError: Cannot read propert(y|ies) of (undefined|null)", "'NoneType' object (has no attribute|is not)",)),
    SeedMode("illegal_state", "pb", 0.45, exceptions=(r"java\.lang\.IllegalStateException", r"java\.lang\.IllegalArgumentException", "^ValueError$",)),
    SeedMode("index_key_error", "pb", 0.5, exceptions=("IndexOutOfBoundsException", "ArrayIndexOutOfBoundsException", "^KeyError$", "^IndexError$",)),
    SeedMode("class_not_found", "ab", 0.6, exceptions=("ClassNotFoundException", "NoClassDefFoundError", "ModuleNotFoundError", "^ImportError$",)),
    SeedMode("file_not_found", "ab", 0.55, exceptions=("FileNotFoundException", "FileNotFoundError",), messages=("No such file or directory",)),
    SeedMode("permission_denied", "si", 0.7, exceptions=("AccessDeniedException", "PermissionError",), messages=("[Pp]ermission denied", "EACCES",)),
    SeedMode("encoding_error", "pb", 0.45, exceptions=("UnicodeDecodeError", "JsonParseException", "JsonMappingException", "JSONDecodeError", "SerializationException",)),
    SeedMode("compile_error", "ab", 0.75, messages=("COMPILATION ERROR", "cannot find symbol", "SyntaxError:", r"error TS\d+", "BUILD FAILED",)),
    SeedMode("dependency_resolution", "si", 0.7, messages=("Could not resolve dependencies", "Could not transfer artifact", "npm ERR!.*(404|ETIMEDOUT|ERESOLVE)", "No matching distribution found", "ResolutionImpossible",)),
    SeedMode("docker_testcontainers", "si", 0.8, exceptions=("ContainerLaunchException",), messages=("Could not find a valid Docker environment", "(pull access denied|manifest unknown|toomanyrequests)", "error during connect: .*docker",)),
    SeedMode("ci_agent_lost", "si", 0.85, messages=("(agent|node|runner).*(disconnect|went offline|lost)", "job was cancell?ed", "received SIGTERM", "The operation was canceled",)),
    SeedMode("env_config_missing", "ab", 0.6, messages=("environment variable.*(not set|missing|is required)", "Missing required (property|configuration)", "Could not resolve placeholder",), words=("config not found",)),
    SeedMode("generic_timeout", "ab", 0.5, messages=("[Tt]est timed out after", "TimeoutError(?!.*selenium)", r"exceeded timeout of \d+", "DeadlineExceeded",)),
    SeedMode("flaky_retry_passed", "nd", 0.7, messages=("(passed|succeeded) (on|after) retry", "Flaky ?[Tt]est", "retr(y|ies).*succe",)),
    SeedMode("concurrent_mod", "pb", 0.55, exceptions=("ConcurrentModificationException", "RaceConditionError",), messages=("optimistic lock(ing)? (failed|exception)",)),
    SeedMode("auth_token_expired", "ab", 0.6, messages=("token (is )?expired", "JWT expired", "session (has )?expired", "invalid_grant",)),
)
