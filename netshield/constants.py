"""Word lists, patterns and field names that results depend on."""

# A request containing one of these is a static asset.
STATIC_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".webp",
    ".css", ".js", ".jsx", ".ts", ".tsx",
    ".ttf", ".woff", ".woff2", ".eot",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".mp3", ".mp4", ".wav", ".avi", ".mov",
    ".txt", ".csv", ".xml", ".json",
)

# Network lists whose traffic is trusted, by category.
SUPPORTED_NETWORKS = {
    "social": ("applebot", "facebookbot", "linkedin", "pinterest", "telegrambot", "twitterbot"),
    "search": ("bingbot", "googlebot", "yahoo", "yandex"),
    "minor_search": ("baidu", "duckduckbot"),
    "analytics": ("ahrefsbot", "semrush"),
    "cdn": ("bunnycdn", "cloudflare"),
    "ai": ("chatgpt", "claude"),
    "lan": ("internal",),
}

# Network lists that are labelled but stay subject to detection.
UNSUPPORTED_NETWORKS = {
    "monitoring": ("outageowl", "betteruptimebot", "pingdombot", "uptimerobot", "webpagetestbot"),
    "minor_crawler": ("freshpingbot", "imagekit", "imgix", "marginalia"),
    "minor_payment": ("molliewebhook", "stripewebhook"),
    "minor_search": ("blekko", "mojeekbot"),
    "minor_aggregator": ("rssapi",),
    "datacenter": ("datacenter",),
    "anonymizer": ("vpn",),
}

# Words that classify an internet provider's name.
ISP_KEYWORDS = {
    "hosting": ("host", "datacenter", "data center", "hosting", "amazon", "google", "microsoft",
                "azure", "aws", "cloud", "digitalocean", "linode", "vultr"),
    "tor": ("tor", "exit node", "torproject"),
    "vpn": ("vpn", "virtual private network", "nordvpn", "expressvpn", "private internet access",
            "protonvpn", "cyberghost", "tunnelbear", "mullvad", "privatevpn"),
    "vps": ("vps", "virtual private server", "vultr", "linode", "digitalocean", "scaleway",
            "ovh", "hetzner"),
}

# Input patterns.
SYSLOG_PATTERN = r"^<(\d+)>(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(.*)"
JSON_PATTERN = r"\{.*\}"
REQUEST_PATTERN = r"(\S+)\s+(\S+)(?:\s+(\S+))?"

# Payload fields of one access-log line.
PAYLOAD_FIELDS = (
    "domain", "timestamp", "timestamp_local", "timestamp_iso8601", "remote_addr", "request",
    "response_status", "body_bytes_sent", "http_referrer", "http_user_agent", "request_time",
    "connection", "connection_requests", "request_length", "upstream_cache_status",
    "upstream_addr", "http_x_forwarded_for", "upstream_response_time",
)

# Feature order expected by a trained model.
FEATURES = (
    "request_count", "request_rate", "unique_paths", "unique_paths_ratio",
    "path_entropy", "method_entropy", "status_entropy",
    "interval_mean", "interval_std", "interval_skew", "interval_kurt",
    "burst_rate", "burst_duration_mean", "burst_size_mean",
    "get_ratio", "post_ratio", "other_method_ratio", "http1_ratio", "http2_ratio",
    "bytes_mean", "bytes_std", "bytes_skew", "bytes_kurt", "bytes_min", "bytes_max",
    "time_mean", "time_std", "time_skew", "time_kurt", "time_min", "time_max",
    "error_rate", "error_4xx_rate", "error_5xx_rate",
    "session_length", "requests_per_second",
)

# Limits of the transport formats.
MAX_DATAGRAM_BYTES = 65535
PREVIEW_BYTES = 24000
PREVIEW_CHARS = 200
GELF_VERSION = "1.1"
GELF_FACILITY = "syslog-server"
