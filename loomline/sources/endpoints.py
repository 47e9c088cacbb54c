"""HTTP endpoints and message topics of source texts, from annotations and calls.

Every annotation and call is parsed once into its dotted name and arguments; what it means is looked up in the tables
below, by framework: which names serve or call, where the path stands, what the method is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from loomline.sources.tokens import Tokens, arguments, tokenize

VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
UPPER, TITLE = tuple(v.upper() for v in VERBS), tuple(v.title() for v in VERBS)


@dataclass
class Use:
    """An annotation or call: its dotted name, where it begins, its arguments and the call whose result it is called on."""

    name: list[str]
    first: int
    open_: int | None
    annotation: bool
    on: int | None = None


def uses(t: Tokens) -> list[Use]:
    """All annotations and calls of a text."""
    out = []
    for k in range(len(t)):
        if not t.is_word(k) or t.get(k - 1) in (".", "?."):
            if not (t.is_word(k) and t.get(k - 1) in (".", "?.") and t.get(k - 2) == ")"):
                continue
        name, j = [t.word[k]], k
        while t.get(j + 1) in (".", "?.") and t.is_word(j + 2):
            j += 2
            name.append(t.word[j])
        open_ = j + 1
        if t.get(open_) == "<":  # type arguments
            i = open_
            while i < min(len(t), open_ + 40) and t.word[i] not in ("(", ";", "{"):
                i += 1
            open_ = i if t.get(i - 1) == ">" else open_
        held = open_ if t.get(open_) == "(" and open_ in t.partner else None
        annotation = t.get(k - 1) == "@"
        if held is not None or annotation:
            on = t.partner.get(k - 2) if t.get(k - 1) in (".", "?.") else None
            out.append(Use(name, k - annotation, held, annotation, on))
    return out


class Arguments:
    """The arguments of a use: literals by place and by name."""

    def __init__(self, t: Tokens, use: Use):
        self.t = t
        self.ranges = arguments(t, use.open_) if use.open_ is not None else []
        self.named: dict[str, tuple[int, int]] = {}
        self.placed: list[tuple[int, int]] = []
        for a, b in self.ranges:
            if t.is_word(a) and t.get(a + 1) == "=":
                self.named[t.word[a]] = (a + 2, b)
            else:
                self.placed.append((a, b))

    def text(self, a: int, b: int) -> str | None:
        """The first literal of an argument, also within brackets."""
        k = a
        while k < b and self.t.word[k] in ("{", "[", "("):
            k += 1
        return self.t.literal(k) if k < b else None

    def at(self, place: int) -> str | None:
        return self.text(*self.placed[place]) if place < len(self.placed) else None

    def of(self, *names: str) -> str | None:
        return next((self.text(*self.named[n]) for n in names if n in self.named), None)

    def last_word(self, place: int | str) -> str | None:
        """The last word of an argument, such as POST of RequestMethod.POST or http.MethodPost."""
        held = self.named.get(place) if isinstance(place, str) else self.placed[place] if place < len(self.placed) else None
        words = [self.t.word[k] for k in range(*held) if self.t.is_word(k)] if held else []
        return words[-1] if words else None

    def field(self, key: str) -> str | None:
        """A literal of an object or composite among the arguments, by its key."""
        for a, b in self.ranges:
            for k in range(a, b - 2):
                if self.t.word[k] == key and self.t.word[k + 1] == ":" and (found := self.t.literal(k + 2)) is not None:
                    return found
        return None


#: (languages, framework, names, method: fixed, or of the name) of annotations that serve; the path is the first literal.
SERVES = {
    "GetMapping": ("spring", "GET"), "PostMapping": ("spring", "POST"), "PutMapping": ("spring", "PUT"), "DeleteMapping": ("spring", "DELETE"), "PatchMapping": ("spring", "PATCH"),
    "Get": ("nestjs", "GET"), "Post": ("nestjs", "POST"), "Put": ("nestjs", "PUT"), "Delete": ("nestjs", "DELETE"), "Patch": ("nestjs", "PATCH"), "Head": ("nestjs", "HEAD"), "Options": ("nestjs", "OPTIONS"),
}
#: Annotations of a class whose path comes before those of its members.
PREFIXES = {"spring": ("RequestMapping",), "nestjs": ("Controller",), "jaxrs": ("Path",)}
#: Methods of RestTemplate and their HTTP methods.
REST_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "put": "PUT", "delete": "DELETE"}
#: Names under which client libraries of scripts and of Python are called.
SCRIPT_CLIENTS = frozenset(("axios", "http", "api", "client", "got", "ky", "request", "instance", "service"))
PYTHON_CLIENTS = frozenset(("requests", "httpx", "session", "client", "aiohttp"))
#: (broker, role, last word of the receiver's name, methods) of calls whose first literal is the topic.
SENDERS = (
    ("kafka", ("template", "producer"), ("send", "sendDefault", "produce")),
    ("rabbitmq", ("rabbittemplate", "amqptemplate"), ("convertAndSend", "send")),
    ("rocketmq", ("rocketmqtemplate", "mqproducer"), ("send", "convertAndSend", "syncSend")),
)
LISTENERS = {"KafkaListener": ("kafka", "topics"), "RabbitListener": ("rabbitmq", "queues"), "RocketMQMessageListener": ("rocketmq", "topic")}


def _broker(receiver: str, method: str) -> str | None:
    """The broker to which a call sends: the most telling receiver name wins."""
    low = receiver.lower().replace("_", "")
    hits = [(len(e), broker) for broker, ends, methods in SENDERS for e in ends if low.endswith(e) and method in methods]
    hits = [h for h in hits if h[1] != "kafka" or low in ("producer", "kafkaproducer", "kafkatemplate")]
    return max(hits)[1] if hits else None


def endpoints(text: str, language: str) -> Iterator[tuple[str, str | None, str, str, int, bool, str]]:
    """(protocol, method, path or topic, role, offset, whether an annotation, framework or broker) of a text; prefixes of
    classes come as role `prefix`."""
    t = tokenize(text, language)
    script, jvm = language in ("javascript", "typescript"), language in ("java", "kotlin")
    every = uses(t)
    by_open = {u.open_: u for u in every if u.open_ is not None}
    clients = set(SCRIPT_CLIENTS) | _instances(t) if script else set()
    for n, u in enumerate(every):
        a, last, at = Arguments(t, u), u.name[-1], t.at[u.first]
        out = lambda protocol, method, path, role, framework: (protocol, method, path, role, at, u.annotation, framework)  # noqa: E731, B023
        first = a.at(0)
        if u.annotation:
            path = a.of("value", "path") or first
            if language == "python" and len(u.name) > 1:
                if last in VERBS and first is not None:
                    yield out("http", last.upper(), first, "server", "fastapi")
                elif last == "route" and first is not None:
                    yield out("http", (a.of("methods") or "GET").upper(), first, "server", "flask")
                elif last == "task" and u.name[0] in ("celery", "app"):
                    yield out("mq", None, a.of("name") or "", "server", "celery")
            elif language == "python" and last == "shared_task":
                yield out("mq", None, a.of("name") or "", "server", "celery")
            elif jvm and last in LISTENERS:
                broker, key = LISTENERS[last]
                if topic := a.of(key) or (first if key != "topic" else None):
                    yield out("mq", None, topic, "server", broker)
            elif last in SERVES and (SERVES[last][0] == "spring") == jvm and (jvm or script):
                framework, method = SERVES[last]
                yield out("http", method, path or "", "server", framework)
            elif jvm and last == "RequestMapping":
                owner = _declares_type(t, u)
                if owner:
                    yield out("http", None, path or "", "prefix", "spring")
                else:
                    yield out("http", (a.last_word("method") or "GET").upper(), path or "", "server", "spring")
            elif jvm and last == "Path":
                if _declares_type(t, u):
                    yield out("http", None, path or "", "prefix", "jaxrs")
                elif method := _beside(t, every, n, UPPER):
                    yield out("http", method, path or "", "server", "jaxrs")
            elif jvm and last in UPPER and not _beside(t, every, n, ("Path",)):
                yield out("http", last, "", "server", "jaxrs")
            elif script and last == "Controller":
                yield out("http", None, path or "", "prefix", "nestjs")
            continue
        receiver = u.name[-2] if len(u.name) > 1 else ""
        if broker := _broker(receiver, last) if first is not None and receiver else None:
            yield out("mq", None, first, "client", broker)
        elif language == "python":
            if last in ("path", "re_path") and not receiver and first is not None and len(a.ranges) > 1:
                yield out("http", "GET", first, "server", "django")
            elif receiver in PYTHON_CLIENTS and last in VERBS and first is not None:
                yield out("http", last.upper(), first, "client", "requests")
            elif last == "send_task" and first is not None:
                yield out("mq", None, first, "client", "celery")
        elif jvm:
            if last in REST_TEMPLATE and first is not None and (receiver or u.on is not None) and (last not in ("put", "delete") or "/" in first):
                yield out("http", REST_TEMPLATE[last], first, "client", "resttemplate")
            elif last == "uri" and first is not None and (before := by_open.get(u.on)) and before.name[-1] in VERBS:
                yield out("http", before.name[-1].upper(), first, "client", "webclient")
        elif script and first is not None:
            if last == "fetch" and len(u.name) == 1:
                yield out("http", (a.field("method") or "GET").upper(), first, "client", "fetch")
            elif last in VERBS and receiver in clients:
                yield out("http", last.upper(), first, "client", "axios")
            elif last in VERBS and receiver and first.startswith(("/", "*")) and len(a.ranges) > 1 and u.name[0] != "this":
                yield out("http", last.upper(), first, "server", "express")
        elif language == "go":
            if receiver == "http" and last in ("Get", "Post", "PostForm", "Head") and first is not None:
                yield out("http", "POST" if last == "PostForm" else last.upper(), first, "client", "net/http")
            elif receiver == "http" and last in ("NewRequest", "NewRequestWithContext"):
                skip = last == "NewRequestWithContext"
                method = a.at(skip) or (a.last_word(int(skip)) or "GET").removeprefix("Method")
                if (url := a.at(1 + skip)) is not None:
                    yield out("http", method.upper(), url, "client", "net/http")
            elif last in ("HandleFunc", "Handle") and first is not None:
                verb, _, path = first.rpartition(" ")  # a pattern may name its method
                yield out("http", verb or "GET", path, "server", "net/http")
            elif receiver and last in UPPER and first is not None:
                yield out("http", last, first, "server", "gin")
            elif receiver and receiver != "http" and last in TITLE and first is not None and first.startswith("/"):
                yield out("http", last.upper(), first, "server", "mux")
            elif last in ("WriteMessages", "Produce") and (topic := a.field("Topic")) is not None:
                yield out("mq", None, topic, "client", "kafka")


def _declares_type(t: Tokens, use: Use) -> bool:
    """Whether what an annotation stands before is a type."""
    k = t.partner[use.open_] + 1 if use.open_ is not None else use.first + 2 * len(use.name)
    while k < len(t):
        w = t.word[k]
        if w == "@" and t.get(k + 1) != "interface":
            k += 2
            while t.get(k) == ".":
                k += 2
            k = t.partner[k] + 1 if t.get(k) == "(" and k in t.partner else k
            continue
        if w in ("class", "interface", "object", "record", "enum"):
            return True
        if not t.is_word(k) or w == "fun":
            return False
        if t.get(k + 1) in ("(", "<", ".", "[") or (t.is_word(k + 1) and t.get(k + 2) == "("):
            return False
        k += 1
    return False


def _beside(t: Tokens, every: list[Use], n: int, names: tuple[str, ...]) -> str | None:
    """The annotation of one of the names on the declaration that annotation `n` stands on."""
    def end(u: Use) -> int:
        return t.partner[u.open_] + 1 if u.open_ is not None else u.first + 2 * len(u.name)

    for step in (1, -1):
        k = n
        while 0 <= k + step < len(every) and every[k + step].annotation:
            a, b = (every[k], every[k + step]) if step > 0 else (every[k + step], every[k])
            if end(a) != b.first:
                break
            k += step
            if every[k].name[-1] in names:
                return every[k].name[-1]
    return None


def _instances(t: Tokens) -> set[str]:
    """Names that a script gives to HTTP client libraries or clients made by them."""
    out = set()
    for k in range(len(t)):
        if t.word[k] in ("const", "let", "var") and t.get(k + 2) == "=" and t.get(k + 3) in ("axios", "got", "ky") and t.is_word(k + 1):
            out.add(t.word[k + 1])
        elif t.word[k] == "from" and t.literal(k + 1) in ("axios", "got", "ky") and t.is_word(k - 1):
            out.add(t.word[k - 1])
    return out
