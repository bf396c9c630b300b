"""Word lists, labels and answer texts.

Everything in this module is data, not logic. The values below are fixed by the behaviour the
library reproduces; all of them can be overridden through parameters of the operators.
"""

# --- Fixed values: the intent labels, in their order (label n of a 0-based code is entry n).
INTENTS = (
    "Order Tracking / Status",
    "Delivery Delay",
    "Delivered but Not Received",
    "Wrong / Damaged / Defective Item",
    "Return / Refund",
    "Order Cancellation",
    "Payment / Billing",
    "Prime Membership / Benefits",
    "Account / Login / Security",
    "Product / App / Website Issue",
    "Customer Support / Complaint",
    "Non-actionable / Exclude",
)
COMPLAINT = "Customer Support / Complaint"
NON_ACTIONABLE = "Non-actionable / Exclude"

# --- Fixed values: messages that only acknowledge.
ACKNOWLEDGEMENTS = (
    "ok", "okay", "thanks", "thank you", "thankyou", "thx", "ty", "got it", "great", "yes",
    "no", "sure", "perfect", "awesome", "appreciate it",
)

# --- Fixed values: phrases that trigger escalation, by profile.
SECURITY_TERMS = {
    "runtime": (
        "can't log in", "cannot log in", "unable to log in", "cannot login", "can't login",
        "password", "hacked", "account hacked", "account stolen", "unauthorized access",
        "security", "phishing", "fraud",
    ),
    "batch": (
        "can't login", "cannot login", "can't log in", "cannot log in", "password", "hacked",
        "account locked", "account hacked", "security",
    ),
}
HUMAN_TERMS = {
    "runtime": (
        "speak to someone", "talk to someone", "speak with someone", "talk with someone",
        "human", "representative", "agent", "call me", "customer service",
    ),
    "batch": (
        "human", "agent", "representative", "someone help me", "speak to someone",
        "talk to someone", "call me",
    ),
}

# --- Fixed values: reason texts of the decision rules, by profile.
REASONS = {
    "runtime": {
        "confidence": "low classification confidence (%.2f)",
        "similarity": "weak historical similarity (%.2f)",
        "security": "account/security issue requires human review",
        "human": "customer requests or indicates need for human support",
        "complaint": "support complaint should be handled by a human",
        "excluded": "message is non-actionable",
        "none": "sufficient confidence, retrieval strength, and no escalation trigger",
    },
    "batch": {
        "confidence": "Low classification confidence",
        "similarity": "Weak historical retrieval similarity",
        "security": "Account/security issue",
        "human": "Customer requests human assistance",
        "complaint": "Customer support complaint",
        "excluded": "Non-actionable message",
        "none": "Sufficient confidence and retrieval",
    },
}

# --- Fixed values: answer texts by intent.
RUNTIME_TEMPLATES = {
    "Order Tracking / Status": "I understand you'd like an update on your order. Please check the latest tracking information and estimated delivery date in your Amazon order details. If you still need help, please contact Amazon support.",
    "Delivery Delay": "I'm sorry that your order has been delayed. Please check the latest tracking information and updated delivery date in your Amazon order details. If the order remains delayed, please contact Amazon support so the delivery can be investigated.",
    "Delivered but Not Received": "I'm sorry that your order is showing as delivered but you haven't received it. Please check around the delivery location and with household members or others who may have accepted the package. If it is still missing, please contact Amazon support so the delivery can be investigated.",
    "Wrong / Damaged / Defective Item": "I'm sorry that you received an incorrect, damaged, or defective item. Please check the order details for the available return or replacement options. If you need further assistance, please contact Amazon support.",
    "Return / Refund": "I understand you're requesting a return or refund. Please check the order details for the available return and refund options. If the refund or return is not progressing as expected, please contact Amazon support.",
    "Order Cancellation": "I understand that you'd like to cancel your order. Please check your order details to see whether cancellation is still available. If you need further assistance, please contact Amazon support.",
    "Payment / Billing": "I understand your concern about the charge. Please review the payment and order details associated with your Amazon account. If the charge is unexpected or incorrect, please contact Amazon support so they can review the billing information.",
    "Prime Membership / Benefits": "I understand your question about Amazon Prime. Please check your Prime membership details and available benefits in your Amazon account. If you need clarification about your membership, please contact Amazon support.",
    "Account / Login / Security": "I'm sorry you're having trouble with your Amazon account. For account or security issues, please use Amazon's official account support options. Please do not share passwords, payment details, or other sensitive information here.",
    "Product / App / Website Issue": "I'm sorry you're experiencing an issue with Amazon's website, app, or product functionality. Please try refreshing or restarting the affected service. If the issue continues, please contact Amazon support for further assistance.",
    "Customer Support / Complaint": "I'm sorry about your experience with our support service. Your concern should be reviewed by a member of the support team. Please contact Amazon support so they can look into the issue and assist you further.",
    "Non-actionable / Exclude": "No automated response generated because the message does not contain a clear actionable support request.",
}
BATCH_TEMPLATES = {
    "Delivered but Not Received": "I'm sorry that your order is showing as delivered but you haven't received it. Please check around the delivery location and with household members or others who may have accepted the package. If it is still missing, please contact Amazon support so the delivery can be investigated.",
    "Delivery Delay": "I'm sorry that your order has been delayed. Please check the latest tracking information and estimated delivery date. If the order is already past the expected date, please contact Amazon support so they can look into the delivery.",
    "Order Tracking / Status": "You can check the latest order status and tracking information from your Amazon orders page. This will show the current shipment status and estimated delivery date.",
    "Wrong / Damaged / Defective Item": "I'm sorry that you received an incorrect or damaged item. Please check the return or replacement options available for the order. If you need further help, please contact Amazon support.",
    "Return / Refund": "Please check the return or refund options available for your order from your Amazon orders page. If the refund or return is not progressing as expected, please contact Amazon support.",
    "Order Cancellation": "Please check your Amazon orders page to see whether the order can still be cancelled. If the cancellation option is unavailable, please contact Amazon support.",
    "Payment / Billing": "Please review the payment and billing details for your order or membership. If you do not recognize the charge or need further clarification, please contact Amazon support.",
    "Prime Membership / Benefits": "Please check your Amazon Prime membership details and available benefits from your account. If you need help with your membership, please contact Amazon support.",
    "Account / Login / Security": "For account or login issues, please use Amazon's official account support options. For your security, do not share passwords, verification codes, or other sensitive information in a public message.",
    "Product / App / Website Issue": "I'm sorry you're experiencing an issue with the Amazon website or app. Please try refreshing the page or restarting the app. If the problem continues, please contact Amazon support.",
    "Customer Support / Complaint": "I'm sorry about your experience with our support. Your concern needs further assistance from our support team, so please contact Amazon support for additional help.",
}
TEMPLATES = {"runtime": RUNTIME_TEMPLATES, "batch": BATCH_TEMPLATES}
FALLBACK = {"runtime": "Please contact Amazon support for further assistance.", "batch": ""}
HANDOVER = {
    "runtime": "Human review required before sending an automated response.",
    "batch": "This request should be reviewed by a human support agent.",
}

# --- Fixed values: response screening terms.
ACTION_TERMS = (
    "please", "check", "contact", "review", "verify", "visit", "return", "refund", "track",
    "update", "restart", "try", "support",
)
SENSITIVE_TERMS = (
    "password", "otp", "one time password", "credit card number", "debit card number", "cvv",
)
INTENT_KEYWORDS = {
    "delivery delay": ("delivery", "arrive", "shipment", "tracking", "late"),
    "delivered but not received": (
        "delivered", "received", "delivery location", "household", "support",
    ),
    "order tracking / status": ("tracking", "order", "delivery", "status"),
    "return / refund": ("return", "refund", "money"),
    "payment / billing": ("payment", "charge", "billing", "account", "support"),
    "prime membership / benefits": ("prime", "membership", "benefits"),
    "account / login / security": ("account", "login", "password", "support"),
    "product / app / website issue": (
        "website", "app", "technical", "restart", "browser", "support",
    ),
    "wrong / damaged / defective item": (
        "damaged", "defective", "wrong", "replacement", "return",
    ),
    "order cancellation": ("cancel", "cancellation", "order"),
    "customer support / complaint": ("support", "help", "customer service", "contact"),
    "non-actionable / exclude": ("support",),
}

# --- Fixed values: the demonstration messages.
DEMO_MESSAGES = (
    "My package was supposed to arrive yesterday but it still hasn't arrived.",
    "The tracking says my package was delivered but I never received it.",
    "I was charged $50 for Prime and I don't understand why.",
    "The item I received is damaged and I want a refund.",
    "I cannot log into my Amazon account.",
    "Your customer service is useless and nobody is helping me.",
    "The Amazon website is not working.",
)

# --- Fixed values: failure-mode texts (rank, mode of the summary, hypothesis).
FAILURE_MODES = (
    (1, "Intent classification confusion",
     "The semantic classifier struggles with overlapping support topics and ambiguous customer wording."),
    (2, "Retrieval returns a semantically similar but wrong-intent case",
     "Semantic similarity alone can rank related delivery, tracking, refund and support cases above the correct issue."),
    (3, "Low-confidence predictions cause over-escalation",
     "Using low classifier confidence as a strong escalation trigger makes the system overly conservative."),
    (4, "Some complex cases are incorrectly auto-handled",
     "A classifier confidence score does not fully capture fraud, delivery investigations, account issues or complex support failures."),
    (5, "Generated responses are not always tightly aligned with the customer intent",
     "The current response generator uses deterministic intent templates rather than directly grounding every sentence in the retrieved historical response."),
)
EXAMPLE_MODES = (
    (1, "Intent classification confusion"),
    (2, "Retrieval returns a wrong-intent historical case"),
    (3, "Over-escalation of routine cases"),
    (4, "Complex cases incorrectly auto-handled"),
    (5, "Generated response is only partially relevant"),
)
RETRIEVAL_EXAMPLE_REASON = "The top retrieved historical case had a different intent."
RESPONSE_EXAMPLE_REASON = (
    "The automated response evaluation marked the response as PARTIAL."
)

# --- Fixed values: evidence sentences of the failure modes.
EVIDENCE = {
    "confusion": "%s was predicted as %s %d times.",
    "retrieval": "%d of %d Golden queries had a top-1 retrieval whose predicted intent did not match the expected intent.",
    "over": "%d routine cases were escalated although the expected decision was AUTO_HANDLE.",
    "missed": "%d cases required human handling but the system selected AUTO_HANDLE.",
    "partial": "%d of %d responses were rated PARTIAL; intent relevance was only %.2f%% in the automated response evaluation.",
}

# --- Fixed values: text tokens a CSV reader of the data-frame world takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Function words per language, written from grammar word lists; used for the stop-word share
# (how English is a text) and, for English, as the default stop list of TF-IDF.
FUNCTION_WORDS = {
    "en": (
        "a", "about", "all", "am", "an", "and", "any", "are", "as", "at", "be", "been", "but",
        "by", "can", "did", "do", "for", "from", "had", "has", "have", "he", "her", "his",
        "how", "i", "if", "in", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or",
        "our", "out", "she", "so", "than", "that", "the", "their", "them", "then", "there",
        "they", "this", "to", "up", "was", "we", "were", "what", "when", "which", "who",
        "will", "with", "you", "your",
    ),
    "fr": (
        "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en", "est", "et",
        "il", "je", "la", "le", "les", "leur", "lui", "mais", "ne", "nous", "on", "ou", "par",
        "pas", "pour", "qu", "que", "qui", "sa", "se", "ses", "son", "sont", "sur", "un",
        "une", "vous",
    ),
    "de": (
        "als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein",
        "eine", "einen", "er", "es", "ich", "ihr", "im", "ist", "mit", "nicht", "sich",
        "sie", "sind", "und", "von", "werden", "wie", "wir", "zu", "zum", "zur",
    ),
    "es": (
        "al", "como", "con", "del", "el", "ella", "ellos", "las", "lo", "los", "mas", "no",
        "nos", "para", "pero", "por", "se", "su", "sus", "una", "uno", "y", "ya", "yo",
    ),
}
