"""Patterns that tell which calls reach other services, and the dependency catalogue they come from."""

from __future__ import annotations

import fnmatch
import os
import warnings
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    """How a connection shows in one language.

    ``module`` is a part of the import path (Go, Python, Java); ``names`` are the
    functions or annotations that open the connection; ``regex`` is matched
    against lines (TypeScript), its first group or else its whole match being the
    target.  ``attribute`` names the annotation attribute or keyword argument that
    holds the target, ``service`` a fixed target service.
    """

    language: str
    conn_type: str
    module: str = ""
    names: tuple[str, ...] = ()
    regex: str = ""
    attribute: str = ""
    service: str = ""
    file_glob: str = ""


@dataclass
class PatternSet:
    """Patterns by language; merging adds without removing repeats."""

    patterns: list[Pattern] = field(default_factory=list)

    def of(self, language: str, path: str = "") -> list[Pattern]:
        """Patterns of a language that may apply to a path."""
        return [p for p in self.patterns if p.language == language and (not p.file_glob or fnmatch.fnmatch(path, p.file_glob))]

    def merged(self, other: PatternSet) -> PatternSet:
        """Both sets, this one first."""
        return PatternSet([*self.patterns, *other.patterns])


# Built-in patterns, used whatever a project depends on.
DEFAULT_PATTERNS = PatternSet(
    [
        Pattern("go", "grpc", "google.golang.org/grpc", ("Dial", "DialContext", "NewClient")),
        Pattern("go", "kafka_publish", "kafka", ("NewWriter", "NewSyncProducer", "NewAsyncProducer", "NewProducer", "NewPusher")),
        Pattern("go", "kafka_consume", "kafka", ("NewReader", "NewConsumer", "NewConsumerGroup", "NewQueue", "MustNewQueue")),
        Pattern("go", "http_api", "net/http", ("NewRequest", "NewRequestWithContext", "Get", "Post", "PostForm", "Head")),
        Pattern("go", "redis", "redis", ("NewClient", "NewClusterClient", "MustNewRedis")),
        Pattern("go", "nats", "nats.go", ("Connect",)),
        Pattern("ts", "http_api", regex=r"""\b(?:axios|api|http|client)\.(?:get|post|put|patch|delete)\s*(?:<[^>]*>)?\(\s*['"`]([^'"`]+)"""),
        Pattern("ts", "http_api", regex=r"""\bfetch\(\s*['"`]([^'"`]+)"""),
        Pattern("ts", "kafka_consume", regex=r"""\.subscribe\(\s*\{\s*topics?\s*:\s*\[?\s*['"`]([^'"`]+)"""),
        Pattern("ts", "kafka_publish", regex=r"""\.send\(\s*\{\s*topic\s*:\s*['"`]([^'"`]+)"""),
        Pattern("ts", "nats", regex=r"""\bnats\.connect\("""),
        Pattern("python", "grpc", "grpc", ("insecure_channel", "secure_channel")),
        Pattern("python", "kafka_consume", "kafka", ("KafkaConsumer", "AIOKafkaConsumer", "Consumer")),
        Pattern("python", "kafka_publish", "kafka", ("KafkaProducer", "AIOKafkaProducer", "Producer"), attribute="topic"),
        Pattern("python", "http_api", "httpx", ("Client", "AsyncClient", "get", "post", "put", "delete"), attribute="base_url"),
        Pattern("python", "http_api", "requests", ("get", "post", "put", "patch", "delete", "Session")),
        Pattern("python", "redis", "redis", ("Redis", "from_url", "StrictRedis")),
        Pattern("java", "grpc", "io.grpc", ("forAddress", "forTarget")),
        Pattern("java", "kafka_consume", "kafka", ("@KafkaListener",), attribute="topics"),
        Pattern("java", "kafka_publish", "kafka", ("ProducerRecord", "send")),
        Pattern("java", "http_api", "openfeign", ("@FeignClient",), attribute="name"),
        Pattern("java", "http_api", "web.client", ("getForObject", "postForObject", "exchange", "getForEntity")),
    ]
)

# Dependency name (a trailing * stands for any rest) to the patterns it brings.
CATALOGUE: dict[str, tuple[Pattern, ...]] = {
    # Go
    "google.golang.org/grpc*": (Pattern("go", "grpc", "grpc", ("Dial", "DialContext", "NewClient")),),
    "github.com/segmentio/kafka-go": (Pattern("go", "kafka_consume", "kafka-go", ("NewReader",)), Pattern("go", "kafka_publish", "kafka-go", ("NewWriter",))),
    "github.com/IBM/sarama*": (Pattern("go", "kafka_consume", "sarama", ("NewConsumer", "NewConsumerGroup")), Pattern("go", "kafka_publish", "sarama", ("NewSyncProducer", "NewAsyncProducer"))),
    "github.com/Shopify/sarama*": (Pattern("go", "kafka_consume", "sarama", ("NewConsumer", "NewConsumerGroup")), Pattern("go", "kafka_publish", "sarama", ("NewSyncProducer", "NewAsyncProducer"))),
    "github.com/confluentinc/confluent-kafka-go*": (Pattern("go", "kafka_consume", "kafka", ("NewConsumer",)), Pattern("go", "kafka_publish", "kafka", ("NewProducer",))),
    "net/http": (Pattern("go", "http_api", "net/http", ("Get", "Post", "Do")),),
    "github.com/go-resty/resty*": (Pattern("go", "http_api", "resty", ("New",)),),
    "github.com/redis/go-redis*": (Pattern("go", "redis", "redis", ("NewClient", "NewClusterClient")),),
    "github.com/nats-io/nats.go": (Pattern("go", "nats", "nats", ("Connect",)),),
    # JavaScript and TypeScript
    "kafkajs": (
        Pattern("ts", "kafka_consume", regex=r"""new\s+Kafka\s*\(\s*\{[^}]*brokers\s*:"""),
        Pattern("ts", "kafka_publish", regex=r"""\.producer\s*\(\s*\)"""),
        Pattern("ts", "kafka_consume", regex=r"""\.consumer\s*\(\s*\{"""),
    ),
    "@grpc/grpc-js": (Pattern("ts", "grpc", regex=r"""new\s+\w+Client\s*\(\s*['"`]([^'"`]+)['"`]"""),),
    "axios": (Pattern("ts", "http_api", regex=r"""axios\.create\s*\(\s*\{[^}]*baseURL\s*:\s*['"`]([^'"`]+)['"`]"""),),
    "ioredis": (Pattern("ts", "redis", regex=r"""new\s+Redis\s*\(\s*['"`]?([^'"`\s)]+)"""),),
    "nats": (Pattern("ts", "nats", regex=r"""connect\s*\(\s*\{[^}]*servers\s*:"""),),
    "@nestjs/microservices": (Pattern("ts", "kafka_consume", regex=r"""@(?:EventPattern|MessagePattern)\(\s*['"`]([^'"`]+)"""),),
    # Python
    "grpcio": (Pattern("python", "grpc", "grpc", ("Stub", "insecure_channel")),),
    "grpcio-tools": (Pattern("python", "grpc", "grpc", ("Stub",)),),
    "kafka-python": (Pattern("python", "kafka_consume", "kafka", ("KafkaConsumer",)), Pattern("python", "kafka_publish", "kafka", ("KafkaProducer",))),
    "confluent-kafka": (Pattern("python", "kafka_consume", "confluent_kafka", ("Consumer",)), Pattern("python", "kafka_publish", "confluent_kafka", ("Producer",))),
    "aiokafka": (Pattern("python", "kafka_consume", "aiokafka", ("AIOKafkaConsumer",)), Pattern("python", "kafka_publish", "aiokafka", ("AIOKafkaProducer",))),
    "httpx": (Pattern("python", "http_api", "httpx", ("Client", "AsyncClient"), attribute="base_url"),),
    "requests": (Pattern("python", "http_api", "requests", ("get", "post")),),
    "aiohttp": (Pattern("python", "http_api", "aiohttp", ("ClientSession",), attribute="base_url"),),
    "redis": (Pattern("python", "redis", "redis", ("Redis",), attribute="host"), Pattern("python", "redis", "redis", ("from_url",))),
    "nats-py": (Pattern("python", "nats", "nats", ("connect",)),),
    # Java
    "io.grpc:grpc*": (Pattern("java", "grpc", "io.grpc", ("newBlockingStub", "forAddress")),),
    "org.springframework.kafka*": (Pattern("java", "kafka_consume", "springframework.kafka", ("@KafkaListener",), attribute="topics"), Pattern("java", "kafka_publish", "springframework.kafka", ("send",))),
    "org.springframework.cloud:spring-cloud-openfeign*": (Pattern("java", "http_api", "openfeign", ("@FeignClient",), attribute="name"),),
    "org.springframework.cloud:spring-cloud-starter-openfeign": (Pattern("java", "http_api", "openfeign", ("@FeignClient",), attribute="name"),),
    "org.springframework:spring-web*": (Pattern("java", "http_api", "springframework.web", ("getForObject", "postForObject")),),
    "org.apache.kafka:kafka-clients": (Pattern("java", "kafka_consume", "apache.kafka", ("subscribe",)), Pattern("java", "kafka_publish", "apache.kafka", ("send",))),
    "io.lettuce:lettuce-core": (Pattern("java", "redis", "lettuce", ("create",)),),
    "io.nats:jnats": (Pattern("java", "nats", "io.nats", ("connect",)),),
}


def catalogue_patterns(dependencies: list[str]) -> PatternSet:
    """Patterns of the dependencies found in a project's manifests, by exact name or prefix, whatever the case."""
    out = []
    for key, patterns in CATALOGUE.items():
        prefix = key[:-1] if key.endswith("*") else None
        if any(d.lower() == key.lower() or prefix is not None and d.lower().startswith(prefix.lower()) for d in dependencies):
            out += patterns
    return PatternSet(out)


def read_patterns(path: str) -> PatternSet:
    """Patterns of a YAML file: a list, or a mapping of languages to lists; none if it is missing or unusable."""
    if not os.path.isfile(path):
        return PatternSet()
    try:
        import yaml
    except ImportError:
        warnings.warn(f"{path} is not read: there is no module yaml", stacklevel=2)
        return PatternSet()
    with open(path, encoding="utf-8") as text:
        try:
            loaded = yaml.safe_load(text) or []
        except yaml.YAMLError:
            return PatternSet()
    items = [(None, loaded)] if isinstance(loaded, list) else list((loaded.get("patterns") or loaded).items()) if isinstance(loaded, dict) else []
    known = Pattern.__dataclass_fields__
    out = []
    for language, entries in items:
        for entry in entries if isinstance(entries, list) else []:
            if isinstance(entry, dict) and entry.get("conn_type"):
                values = {k: tuple(v) if k == "names" else str(v) for k, v in entry.items() if k in known}
                out.append(Pattern(**({"language": language or "go"} | values)))
    return PatternSet(out)


def load_patterns(repository: str, dependencies: list[str], home: str | None = None, name: str = "codeloom.yaml") -> PatternSet:
    """Built-in patterns, then those of the dependencies, the user's file and the repository's file."""
    found = DEFAULT_PATTERNS.merged(catalogue_patterns(dependencies))
    for folder in (home if home is not None else os.path.expanduser("~"), repository):
        found = found.merged(read_patterns(os.path.join(folder, name)))
    return found
