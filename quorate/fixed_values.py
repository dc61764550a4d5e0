"""Limits, names, texts and tables that results depend on."""

# Request limits.
QUESTION_CHARS = (3, 1000)
DOCUMENTS_PER_CASE = (1, 10)
DOCUMENT_CHARS = (1, 20_000)
TOTAL_CHARS = 50_000

# Panel limits and defaults.
MAX_SPECIALISTS = 10
MAX_RETRIES = 3
REQUEST_TIMEOUT_SECONDS = 60
FALLBACK_SPECIALTY = "Internal Medicine"
UNKNOWN_SPECIALTY = "Unknown"
NOTHING_FOUND = "No relevant information found"

# Texts.
DOCUMENT_SEPARATOR = "\n\n---\n\n"
QUESTION_HEADING = "## Clinical Question\n"
DOCUMENTS_HEADING = "\n\n## Patient Documents\n"
DEFAULT_MESSAGES = {
    "triage": "Analyzing...",
    "specialist": "Analyzing...",
    "judge": "Synthesizing...",
    "safety": "Verifying...",
    "error": "The pipeline stopped unexpectedly.",
}

# Names and messages of the event log; {} is filled in.
AGENT_NAMES = {
    "triage": "supervisor_agent",
    "panel": "orchestrator",
    "judge": "judge_agent",
    "safety": "safety_agent",
}
SPECIALIST_PREFIX = "specialist_"
LEAD_SUFFIX = " (Lead)"
TRACE_MESSAGES = {
    "triage": "Supervisor analyzing clinical focus and determining specialist team...",
    "specialist": "Analyzing from {} perspective...",
    "discussion": "Summarizing reviews. Lead Specialist: {}.",
    "judge": "Medical Judge synthesizing reviews and resolving conflicts...",
    "safety": "Final safety agent verifying Judge's report against documents...",
}

# Agreement scoring.
LARGEST_SPREAD = 0.5
SMALLEST_OUTLIER_GAP = 0.15
LEVELS = (("strong", 0.75), ("moderate", 0.50), ("weak", 0.25))
NO_LEVEL = "none"

# Event types; the last one is sent outside the declared list.
EVENT_TYPES = (
    "triage_thinking",
    "triage_done",
    "specialists_spawned",
    "specialist_thinking",
    "specialist_done",
    "consensus_done",
    "discussion_summary",
    "judge_thinking",
    "judge_done",
    "agent_stream",
    "safety_thinking",
    "safety_done",
    "error",
    "pipeline_complete",
)

# Failure classes: words looked for in the lower-cased text, exception names.
FAILURE_CLASSES = (
    ("auth", ("authentication", "api key", "api_key", "missing credentials"),
     ("AuthenticationError",)),
    ("rate_limit", ("rate limit",), ("RateLimitError",)),
    ("connectivity", ("connection", "timeout"),
     ("APIConnectionError", "APITimeoutError")),
)

# Specialty, indicators, lead potential.
INDICATOR_MAP = """\
| Specialty | Key Indicators / Keywords | Lead Potential |
| :--- | :--- | :--- |
| **Cardiologist** | ECG, EKG, heart failure, arrhythmia, chest pain, troponin, echocardiogram, hypertension. | High |
| **Neurologist** | Stroke, seizure, neuropathy, MRI Brain, CT Head, syncope, tremors, cognitive decline. | High |
| **Pulmonologist** | COPD, asthma, pneumonia, SOB (shortness of breath), PFTs, CXR, pulse oximetry, intubation. | High |
| **Gastroenterologist** | GI bleed, endoscopy, colonoscopy, cirrhosis, abdominal pain, LFTs, jaundice, nausea. | Medium |
| **Nephrologist** | AKI, CKD, creatinine, dialysis, electrolyte imbalance, proteinuria, hematuria. | Medium |
| **Endocrinologist** | Diabetes, HbA1c, thyroid, adrenal, pituitary, hypoglycemia, hyperglycemia. | Medium |
| **Infectious Disease** | Fever, sepsis, cultures, antibiotics, HIV, MRSA, leukocytosis, procalcitonin. | High |
| **Oncologist** | Malignancy, biopsy, chemotherapy, radiation, staging, PET scan, tumor markers. | High |
| **Radiologist** | Imaging interpretation, X-ray, CT, MRI, Ultrasound, PET, Interventional. | Low |
| **Pharmacist** | Medication reconciliation, drug interactions, dosing, polypharmacy, contraindications. | Low |
| **Surgeon (General)** | Acute abdomen, trauma, pre-op, post-op, hernia, appendicitis, cholecystitis. | High |
"""
