"""Pay-as-you-go services: how they are recognised and how risky their bill is."""

from __future__ import annotations

from dataclasses import dataclass

from fleetlint.catalog.rules import INFO, WARNING, Rule


@dataclass(frozen=True)
class Service:
    service_id: str
    name: str
    billing_model: str
    risk_level: str
    env_keys: tuple[str, ...]
    code_patterns: tuple[str, ...]
    words: tuple[str, ...]  # one of them is in every text the patterns match, in lower case
    message: str
    fix: str

    @property
    def severity(self) -> str:
        return WARNING if self.risk_level in ("high", "medium") else INFO


# --- Fixed values: ids, names, billing, risk, keys and patterns decide results --

SERVICES = (
    Service("openai", "OpenAI API", "per-token", "high", ("OPENAI_API_KEY",),
            (r"openai\.", r"from openai import", r"ChatCompletion", r"openai\.chat"),
            ("openai", "chatcompletion"), "Billed by token without a natural ceiling.",
            "Set a monthly limit, cache answers, throttle calls."),
    Service("anthropic", "Anthropic API", "per-token", "high", ("ANTHROPIC_API_KEY",),
            (r"anthropic\.", r"from anthropic import", r"messages\.create"),
            ("anthropic", "messages.create"), "Billed by token; price depends on the model.",
            "Set a monthly limit, cache answers, use a small model for small tasks."),
    Service("aws_s3", "AWS S3", "storage+transfer", "medium", ("AWS_ACCESS_KEY_ID", "AWS_BUCKET"),
            (r"S3Client", r"PutObjectCommand", r"s3\.upload", r"boto3.*s3"),
            ("s3client", "putobjectcommand", "s3.upload", "boto3"),
            "Stored bytes and outgoing traffic are billed.", "Expire objects, compress, serve through a CDN."),
    Service("aws_lambda", "AWS Lambda", "per-invocation", "medium", ("AWS_LAMBDA_FUNCTION_NAME",),
            (r"exports\.handler", r"lambda_handler", r"@app\.lambda_function"),
            ("exports.handler", "lambda_handler", "@app.lambda_function"),
            "Calls and run time are billed; a trigger loop is costly.", "Cap concurrency and watch call counts."),
    Service("firebase_firestore", "Firebase Firestore", "per-read/write", "high",
            ("FIREBASE_PROJECT_ID", "NEXT_PUBLIC_FIREBASE"),
            (r"firestore\(\)", r"collection\(", r"doc\(", r"getDocs", r"onSnapshot"),
            ("firestore()", "collection(", "doc(", "getdocs", "onsnapshot"),
            "Each read and write is billed, listeners multiply them.", "Cache reads, close listeners, set alarms."),
    Service("vercel", "Vercel", "bandwidth+functions", "medium", ("VERCEL_TOKEN", "VERCEL"),
            (r"@vercel/", r"vercel\.json"), ("@vercel/", "vercel.json"),
            "Traffic and function calls beyond the free tier are billed.", "Cache pages and shrink images."),
    Service("supabase", "Supabase", "per-project+bandwidth", "low",
            ("SUPABASE_URL", "SUPABASE_ANON_KEY", "NEXT_PUBLIC_SUPABASE"),
            (r"createClient\(", r"supabase\.", r"@supabase/"), ("createclient(", "supabase.", "@supabase/"),
            "The free tier is small, plans are per project.", "Watch traffic and limit connections."),
    Service("stripe", "Stripe", "per-transaction", "medium", ("STRIPE_SECRET_KEY", "STRIPE_PUBLISHABLE_KEY"),
            (r"stripe\.", r"Stripe\(", r"checkout\.sessions"), ("stripe.", "stripe(", "checkout.sessions"),
            "A share of each payment is kept; a lost webhook loses a sale.",
            "Verify signatures and make handlers repeatable."),
    Service("twilio", "Twilio", "per-message/call", "high", ("TWILIO_ACCOUNT_SID", "TWILIO_AUTH_TOKEN"),
            (r"twilio\.", r"Twilio\(", r"messages\.create"), ("twilio.", "twilio(", "messages.create"),
            "Each message and minute is billed; a loop is costly.", "Throttle, validate numbers, set limits."),
    Service("algolia", "Algolia", "per-search+record", "medium", ("ALGOLIA_APP_ID", "ALGOLIA_API_KEY"),
            (r"algoliasearch\(", r"\.search\(", r"algolia"), (".search(", "algolia"),
            "Searches and records are billed.", "Debounce input and read the usage report."),
    Service("google_maps", "Google Maps", "per-request", "medium",
            ("GOOGLE_MAPS_API_KEY", "NEXT_PUBLIC_GOOGLE_MAPS"),
            (r"@googlemaps", r"google\.maps", r"maps\.googleapis"), ("@googlemaps", "google.maps", "maps.googleapis"),
            "Each map and geocoding request is billed.", "Restrict the key and cache results."),
    Service("replicate", "Replicate", "per-prediction", "high", ("REPLICATE_API_TOKEN",),
            (r"replicate\.run", r"replicate\.predictions"), ("replicate.run", "replicate.predictions"),
            "GPU time is billed; a loop is costly.", "Set quotas per user and queue calls."),
    Service("pinecone", "Pinecone", "per-pod/serverless", "medium", ("PINECONE_API_KEY",),
            (r"pinecone\.", r"Pinecone\(", r"upsert\(", r"query\("), ("pinecone.", "pinecone(", "upsert(", "query("),
            "Capacity or reads and writes are billed.", "Batch writes and drop unused indexes."),
    Service("sendgrid", "SendGrid", "per-email", "low", ("SENDGRID_API_KEY",),
            (r"@sendgrid/mail", r"sgMail", r"sendgrid"), ("sendgrid", "sgmail"),
            "Mail beyond a daily free amount is billed.", "Validate addresses and watch bounces."),
    Service("resend", "Resend", "per-email", "low", ("RESEND_API_KEY",),
            (r"resend\.", r"Resend\("), ("resend.", "resend("),
            "Mail beyond a monthly free amount is billed.", "Send in batches."),
)

# --- End of fixed values ----------------------------------------------------

# One existence rule for each service: its patterns joined by "or".
SERVICE_RULES = tuple(
    Rule("service", "service", s.service_id, s.severity,
         "|".join(f"(?:{p})" for p in s.code_patterns), s.message, s.fix,
         needs=(s.words,), multiline=False, exists_only=True)
    for s in SERVICES
)
