"""Keyword lists and patterns that decide flags, job families and regions.

Matching is by substring on normalised text, so ``it`` also hits ``security``.
"""

FLAG_KEYWORDS = {
    "f_education_d3": ["d3", "diploma 3", "diploma iii"],
    "f_education_s1": ["s1", "sarjana", "bachelor", "undergraduate"],
    "f_education_s2": ["s2", "magister", "master"],
    "f_ipk_required": ["ipk", "gpa"],
    "f_major_it": [
        "informatika", "teknik informatika", "sistem informasi", "computer science",
        "information system", "it", "software",
    ],
    "f_major_engineering": [
        "teknik", "engineering", "electrical", "mechanical",
        "industrial engineering", "civil engineering",
    ],
    "f_major_business": [
        "manajemen", "management", "akuntansi", "accounting", "ekonomi", "business",
        "administrasi bisnis",
    ],
    "f_academic_achievement": [
        "prestasi akademik", "academic achievement", "competition", "lomba", "kompetisi",
        "award", "penghargaan",
    ],
    "f_scholarship": ["beasiswa", "scholarship"],
    "f_transcript_required": ["transkrip", "transcript"],
    "f_certificate_required": [
        "sertifikat", "certificate", "certification", "toefl", "ielts", "toeic", "brevet", "bnsp",
    ],
    "f_english_required": ["english", "bahasa inggris", "toefl", "ielts", "toeic"],
    "f_computer_skill_required": [
        "komputer", "computer", "microsoft office", "excel", "word", "powerpoint", "sql",
        "python", "java", "javascript",
    ],
    "f_portfolio_required": ["portofolio", "portfolio", "github", "behance", "showcase"],
    "f_project_required": [
        "project", "proyek", "capstone", "final project", "tugas akhir", "skripsi",
    ],
    "f_organization_required": [
        "organisasi", "organization", "organisational", "organizational", "himpunan", "bem", "ukm",
    ],
    "f_leadership_required": [
        "leadership", "kepemimpinan", "memimpin", "leader", "ketua", "koordinator",
    ],
    "f_student_cadre_proxy": [
        "student cadre", "class cadre", "pengurus", "ketua organisasi", "anggota organisasi",
        "aktif organisasi",
    ],
    "f_event_committee": ["panitia", "committee", "event organizer", "event", "volunteer"],
    "f_communication_required": [
        "komunikasi", "communication", "communicative", "presentation", "presentasi",
    ],
    "f_teamwork_required": [
        "teamwork", "team work", "kerja sama tim", "bekerja dalam tim", "collaboration",
        "kolaborasi",
    ],
    "f_internship_required": ["magang", "internship", "intern", "praktek kerja", "pkl"],
    "f_fresh_graduate_allowed": [
        "fresh graduate", "fresh graduates", "lulusan baru", "entry level", "graduate trainee",
        "management trainee",
    ],
    "f_work_experience_required": ["pengalaman kerja", "work experience", "experienced"],
}

# First list with a hit decides, in this order.
JOB_FAMILIES = [
    ("data", ["data analyst", "data scientist", "data engineer", "business intelligence", "sql",
              "python", "machine learning"]),
    ("software", ["programmer", "developer", "software", "frontend", "backend", "fullstack",
                  "web developer", "mobile developer"]),
    ("business", ["business analyst", "management trainee", "sales", "marketing",
                  "account executive"]),
    ("finance", ["finance", "accounting", "akuntansi", "tax", "audit"]),
    ("administration", ["admin", "administrasi", "staff operasional", "operation staff"]),
    ("engineering", ["engineer", "teknik", "mechanical", "electrical", "civil"]),
]
OTHER_FAMILY = "other"

REGIONS = [
    ("jabodetabek", ["jakarta", "bogor", "depok", "tangerang", "bekasi"]),
    ("jawa barat", ["bandung", "cimahi"]),
    ("jawa timur", ["surabaya", "malang", "sidoarjo"]),
    ("jawa tengah diy", ["semarang", "solo", "yogyakarta", "jogja"]),
    ("kalimantan", ["balikpapan", "samarinda", "bontang", "kalimantan"]),
    ("sumatera", ["medan", "palembang", "pekanbaru", "batam", "sumatera"]),
    ("sulawesi", ["makassar", "manado", "sulawesi"]),
]

# The later, longer lists used to repair a stored table; the order differs too.
REPAIR_REGIONS = [
    ("jabodetabek", [
        "jakarta", "bogor", "depok", "tangerang", "bekasi", "kelapa gading", "cempaka putih",
        "cilandak", "pancoran", "kalideres", "penjaringan", "cakung", "cengkareng", "kebon jeruk",
        "kemayoran", "grogol petamburan", "kebayoran lama", "ciputat", "serpong", "karawaci",
        "cileungsi", "gunung putri", "cibitung", "cikarang",
    ]),
    ("jawa barat", [
        "bandung", "karawang", "purwakarta", "cirebon", "majalengka", "sukabumi", "padalarang",
        "margaasih", "cileunyi",
    ]),
    ("jawa tengah diy", [
        "semarang", "yogyakarta", "di yogyakarta", "sleman", "bantul", "surakarta", "kendal",
        "jepara", "batang", "sukoharjo",
    ]),
    ("jawa timur", [
        "surabaya", "sidoarjo", "mojokerto", "jombang", "gresik", "malang", "kediri",
        "bojonegoro", "ngoro", "gedangan", "tenggilis mejoyo", "sambikerep", "waru", "jawa timur",
    ]),
    ("sumatera", [
        "medan", "batam", "pekanbaru", "palembang", "lampung", "jambi", "bengkulu", "prabumulih",
        "deli serdang", "sumatera selatan",
    ]),
    ("kalimantan", [
        "kalimantan", "balikpapan", "samarinda", "bontang", "tarakan", "banjarmasin",
        "banjarbaru", "martapura", "palangkaraya", "palangka raya", "pontianak",
        "pontianak kota", "singkawang", "pangkalan bun", "sampit",
    ]),
    ("sulawesi", ["makassar", "sulawesi", "morowali", "tomohon"]),
]
OTHER_REGION = "lainnya"
UNKNOWN_REGION = "unknown"

# Minimum GPA: tried in this order, first hit of each, group 1 is the number.
GPA_PATTERNS = [
    r"ipk\s*(?:minimal|min|minimum|>=|di atas|lebih dari)?\s*[:\-]?\s*([0-4](?:[\.,][0-9]{1,2})?)",
    r"gpa\s*(?:minimal|min|minimum|>=)?\s*[:\-]?\s*([0-4](?:[\.,][0-9]{1,2})?)",
    r"minimum\s+gpa\s*([0-4](?:[\.,][0-9]{1,2})?)",
]

# Years of experience: every hit of both, group 1 is the number.
EXPERIENCE_PATTERNS = [
    r"(?:minimal|min|minimum|at least)?\s*(\d+)\s*(?:tahun|thn|year|years)\s*(?:pengalaman|experience)",
    r"(?:pengalaman|experience)\s*(?:minimal|min|minimum)?\s*(\d+)\s*(?:tahun|thn|year|years)",
]

CURRENCY_MARKERS = ["rp", "idr"]
MILLION_MARKERS = ["juta", "jt"]
# Amounts of money: each pattern scans the whole text by itself. The words beside a pattern are
# those of which it needs one.
AMOUNT_PATTERNS = [
    (r"(?:rp|idr)\s*[0-9][0-9\.,]*\s*(?:juta|jt|k)?", CURRENCY_MARKERS),
    (r"[0-9]+(?:[\.,][0-9]+)?\s*(?:juta|jt)", MILLION_MARKERS),
    (r"[0-9]{1,3}(?:\.[0-9]{3}){1,3}", []),
    (r"[0-9]{6,9}", []),
]
LOWEST_PAY = 500_000
HIGHEST_PAY = 100_000_000

# Tokens that mark a pay snippet inside a card text, and the words kept around one.
SNIPPET_MARKERS = ["rp", "idr", "juta", "jt"]
SNIPPET_WORDS_BEFORE = 6
SNIPPET_WORDS_AFTER = 10
SNIPPET_CHUNKS = 3
