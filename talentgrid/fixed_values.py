"""Word lists, maps, patterns and thresholds that define the results.

They are data, not logic. Larger rule tables (role keywords, dictionaries,
vocabularies, taxonomies) are not here: they enter operators as DataFrames.
"""

# --- fixed values: skill-list cleaning -------------------------------------
NOISY_SKILLS = [
    "Analyze", "Analysis", "Adapt", "Develop", "Development", "Create", "Reduce", "REDUCE",
    "Make", "Build", "Design", "Support", "Implement", "Deploy", "Monitor", "Test", "Manage",
    "Review", "Ensure", "Maintain", "Use", "Post", "POST", "Programming languages",
    "Programming Language", "Deadline", "deadline", "MAGIC", "Magic", "Google", "LinkedIn",
    "J", "xv",
]
VALID_SHORT_SKILLS = ["C", "Go", "R", "C#", "C++", ".NET"]

# --- fixed values: role rules ----------------------------------------------
FALLBACK_ROLE = "General IT Specialist"
FALLBACK_SOURCE = "fallback"
FALLBACK_KEYWORD = "fallback_no_match"
FIELD_WEIGHTS = [
    ("standardizedTitle", 5), ("title", 4), ("jobFunction", 2), ("industries", 1),
    ("descriptionText", 1),
]
EXCLUDED_ROLES = [
    "Sales Executive", "Operations Specialist", "Digital Marketing Specialist",
    "Risk & Compliance Analyst", "Finance Analyst", "Human Resources Specialist",
    "Customer Service", "Researcher", "Healthcare Professional",
    "Design/Creative Specialist", "Lecturer/Trainer", "Legal Specialist", "Technical Writer",
]
ROLE_MERGES = {
    "Game Developer": "Software Engineer",
    "UI/UX Designer": "Frontend Developer",
    "Project Manager": "Product Manager",
    "Data Governance Specialist": "Data Engineer",
    "Data Architect": "Data Engineer",
    "IT Support Specialist": "General IT Specialist",
    "System Administrator": "General IT Specialist",
    "Penetration Tester": "Cyber Security Analyst",
    "Enterprise Architect": "Solutions Architect",
    "Blockchain Developer": "Software Engineer",
    "Cybersecurity Engineer": "Security Engineer",
    "Product/Project Manager": "Product Manager",
}
MIN_ROLE_ROWS = 100
MODELLING_COLUMNS = [
    "applicantsCount", "applyMethod", "companyName", "country", "employmentType", "industries",
    "jobFunction", "location", "postedAt", "seniorityLevel", "standardizedTitle", "final_role",
    "role_label", "workRemoteAllowed", "hard_skills", "skill_count",
]
NULL_WORDS = ["undefined", "nan", "none", ""]
SENIORITY_ORDER = [
    "Entry level", "Associate", "Mid-Senior level", "Director", "Executive", "Not Applicable",
]

# --- fixed values: dictionary extraction -----------------------------------
EXTRA_DICTIONARY = ["C++", "C#", ".NET", "Node.js", "React.js", "Next.js", "Vue.js", "CSS", "HTML"]
DICTIONARY_ALIASES = {
    "SQL": ["SLQ", "SLQ librabry", "SLQ Library"],
    "JavaScript": ["Javascript", "Javascritp", "JS"],
    "TypeScript": ["Typescript", "TS"],
    "Python": ["Phython", "Pyton"],
    "React.js": ["React", "ReactJS", "React js"],
    "Node.js": ["Node", "NodeJS", "Node js"],
    "Vue.js": ["Vue", "VueJS", "Vue js"],
    "Next.js": ["Next", "NextJS", "Next js"],
    "C++": ["C ++", "cpp"],
    "C#": ["C #", "CSharp", "C-Sharp"],
}

# --- fixed values: vocabulary stop list and synonyms ------------------------
STOP_SKILLS = [
    "deadline", "adapt", "adaptable", "adaptability", "reduce", "post", "google", "linkedin",
    "facebook", "twitter", "instagram", "tiktok", "programming language", "magic",
    "tracking software", "analyze", "coordinate", "collaborate", "communicate", "team player",
    "teamwork", "leadership", "problem solving", "critical thinking", "analytical",
    "attention to detail", "time management", "multitask", "multitasking", "organization",
    "organizational", "self-motivated", "proactive", "creative", "innovative", "flexible",
    "work ethic", "interpersonal", "verbal", "written", "presentation", "negotiation",
    "persuasion", "conflict resolution", "decision making", "strategic thinking", "planning",
    "scheduling", "budgeting", "reporting", "ms office", "word", "powerpoint", "outlook",
    "detail-oriented", "fast learner", "quick learner", "willingness", "initiative",
    "integrity", "punctual", "responsible", "reliable", "honest", "diligent", "enthusiastic",
    "positive attitude", "slack", "zoom", "teams",
]
SYNONYMS = {
    "kubernete": "kubernetes", "k8s": "kubernetes", "kube": "kubernetes",
    "nodejs": "node.js", "node js": "node.js",
    "reactjs": "react", "react.js": "react", "react js": "react",
    "vuejs": "vue.js", "vue js": "vue.js",
    "angularjs": "angular", "angular js": "angular",
    "postgres": "postgresql", "psql": "postgresql",
    "mongo": "mongodb", "mongod": "mongodb",
    "rest api": "restful api", "rest apis": "restful api",
    "graphql api": "graphql",
    "dotnet": ".net", ".net core": ".net",
    "spring": "spring boot",
    "scikit learn": "scikit-learn", "sklearn": "scikit-learn",
    "natural language processing": "nlp",
    "object oriented programming": "oop", "object-oriented programming": "oop",
    "microservice": "microservices", "microservice architecture": "microservices",
    "microservices architecture": "microservices",
    "version control": "git",
    "agile methodology": "agile", "agile scrum": "agile",
    "scrum methodology": "scrum",
    "test driven development": "tdd",
    "html5": "html", "html & css": "html/css", "html and css": "html/css",
    "css3": "css", "sass/scss": "sass", "scss": "sass",
    "tailwindcss": "tailwind css",
    "express.js": "express", "expressjs": "express",
    "nextjs": "next.js", "nestjs": "nest.js", "nuxtjs": "nuxt.js",
    "elastic search": "elasticsearch",
    "apache kafka": "kafka", "apache spark": "spark",
    "microsoft sql server": "sql server", "ms sql": "sql server", "mssql": "sql server",
    "nosql database": "nosql",
    "google cloud": "gcp", "google cloud platform": "gcp",
    "amazon web services": "aws", "amazon aws": "aws",
    "microsoft azure": "azure", "azure cloud": "azure",
    "bash scripting": "bash", "shell scripting": "bash",
    "python3": "python", "python 3": "python",
    "golang": "go",
    "c sharp": "c#",
    "kotlin android": "kotlin", "swift ios": "swift", "flutter dart": "flutter",
    "jupyter notebook": "jupyter", "tableau desktop": "tableau", "jira software": "jira",
    "material-ui": "material ui", "figma design": "figma", "unity3d": "unity",
    "gitlab ci": "gitlab", "ci/cd pipeline": "ci/cd",
    "continuous integration": "ci/cd", "continuous deployment": "ci/cd",
    "sqlite3": "sqlite", "oracle db": "oracle database", "redis cache": "redis",
    "linux server": "linux", "docker container": "docker", "docker containers": "docker",
}

# --- fixed values: display aliases ------------------------------------------
SKILL_ALIASES = {
    "js": "JavaScript", "ts": "TypeScript", "py": "Python", "k8s": "Kubernetes",
    "tf": "TensorFlow", "pt": "PyTorch", "pg": "PostgreSQL", "postgres": "PostgreSQL",
    "mongo": "MongoDB", "gcp": "Google Cloud Platform", "aws": "Amazon Web Services",
    "react.js": "React", "reactjs": "React", "vue.js": "Vue", "vuejs": "Vue",
    "node.js": "Node.js", "nodejs": "Node.js", "next.js": "Next.js", "nextjs": "Next.js",
    "nuxtjs": "Nuxt", "nest.js": "NestJS", "nestjs": "NestJS", "express.js": "Express",
    "expressjs": "Express", "angular.js": "Angular", "angularjs": "Angular",
    "spring boot": "Spring Boot", "springboot": "Spring Boot",
    "scikit-learn": "Scikit-learn", "sklearn": "Scikit-learn", "scikit learn": "Scikit-learn",
    "hugging face": "HuggingFace", "huggingface": "HuggingFace",
    "github actions": "GitHub Actions", "gitlab ci": "GitLab CI", "ci/cd": "CI/CD",
    "cicd": "CI/CD", "apache spark": "Spark", "pyspark": "PySpark", "ruby on rails": "Rails",
    "ror": "Rails", "asp.net": "ASP.NET", ".net": ".NET", "dotnet": ".NET",
    "visual studio code": "VS Code", "vscode": "VS Code",
    "google cloud": "Google Cloud Platform", "microsoft azure": "Azure",
    "amazon web services": "AWS", "weights and biases": "Weights & Biases",
    "wandb": "Weights & Biases", "react native": "React Native", "flutter": "Flutter",
    "power bi": "Power BI", "sql server": "SQL Server", "mssql": "SQL Server",
    "elastic": "Elasticsearch", "elasticsearch": "Elasticsearch", "argo cd": "ArgoCD",
    "argocd": "ArgoCD", "apache airflow": "Airflow", "llama index": "LlamaIndex",
    "llamaindex": "LlamaIndex",
}
DEFAULT_CATEGORY = "other_tools"

# --- fixed values: validity block-lists --------------------------------------
GARBAGE_WORDS = ["undefined", "null", "nan", "none", "placeholder", "-", "n/a", "na"]
SHORT_SKILLS_2 = ["go", "c", "r", "js", "ts", "ip", "ui", "ux", "qt", "db"]
SKILL_BLOCKLIST = [
    "english", "indonesian", "moderate", "native", "fluent", "basic", "intermediate", "advanced",
    "www", "gmail", "linkedin", "github", "http", "https", "com", "id", "io",
    "certifications", "certification", "training", "education", "experience", "about", "profile",
    "summary", "contact", "references", "programming", "data", "structures", "software", "cloud",
    "databases", "algorithms", "debugging", "distribution", "modern", "rule", "lecturers",
    "teaching", "assistants", "teaching assistants", "response collection",
    "programming courses", "coding camp", "academic", "deployment", "al", "linked", "full",
    "replica", "ssl", "backup", "incremental", "differential", "replication",
    "scala programming", "basic programming", "core programming", "modern web development",
    "replica database", "disaster recovery", "proffesion", "profession", "web applications",
    "jawa barat", "jawa", "barat", "sumatera", "utara", "sumatera utara", "indonesia", "bogor",
    "jakarta", "bandung", "surabaya", "medan", "mage", "its", "ipb", "university",
    "universitas", "institut", "pertanian", "institut pertanian bogor", "ipb university",
    "proton catalyst", "proton", "catalyst", "career development", "assessment", "fr",
    "competition", "functionality", "multimedia", "game event", "event", "category", "student",
    "sixth-semester", "semester", "extensive", "new features", "system", "enhancements",
    "applications", "expected", "present", "tutor", "programmer", "developer", "intern",
    "junior programmer",
]
COMPANY_BLOCKLIST = [
    "full", "id", "be", "pb", "men", "port", "per", "edu", "bog", "anian", "camp", "the", "and",
    "of", "in", "at", "to", "for", "by", "remote", "bogor", "jakarta", "bandung", "surabaya",
    "indonesia", "backend", "frontend", "mobile", "web", "cloud", "data", "intern", "staff",
    "engineer", "developer", "manager", "officer", "english", "indonesian", "japanese",
    "mandarin", "chinese", "multi", "cohort", "competency", "relevant", "about", "institut",
    "university", "institute", "college", "academy", "foundation",
]
DESIGNATION_BLOCKLIST = ["work", "job", "per", "member", "staff", "him"]
NAME_BLOCKLIST = [
    "education level", "education", "work experience", "work experiences", "technical skills",
    "skills", "experience", "contact", "summary", "about me", "projects", "certifications",
    "languages", "language", "coursework", "awards", "honors", "activities", "publications",
    "interests",
]
LOCATION_BLOCKLIST = [
    "indonesian", "english", "japanese", "mandarin", "chinese", "korean", "arabic", "french",
    "german", "spanish", "portuguese", "malay", "javanese", "sundanese", "native", "fluent",
    "moderate", "basic", "intermediate", "advanced", "bilingual", "relevant", "courses",
    "certifications", "certification", "training", "education", "skills", "experience", "about",
    "summary", "profile", "contact", "references", "technical",
]
RECOMMENDATION_BLOCKLIST = [
    "facebook", "twitter", "youtube", "instagram", "tiktok", "linkedin", "pinterest",
    "snapchat", "whatsapp", "telegram", "wechat", "line", "medium", "reddit",
]
SURFACE_BLOCKLIST = [
    "skills", "experience", "education", "languages", "frameworks", "tools", "technologies",
    "technical", "certifications", "summary", "profile", "objective", "references", "hobbies",
    "interests", "activities", "publications", "projects", "achievements", "b.sc", "b.s",
    "m.sc", "m.s", "ph.d", "phd", "b.e", "b.tech", "m.tech", "mba", "b.a", "m.a", "b.eng",
    "m.eng", "b.com", "m.com", "bsc", "msc", "btech", "mtech", "b.eng.", "m.eng.", "bachelor",
    "bachelors", "master", "masters", "doctorate", "diploma", "university", "college",
    "institute", "academy", "school", "faculty", "january", "february", "march", "april",
    "june", "july", "august", "september", "october", "november", "december", "•", "·", "-",
    "–", "—",
]
KNOWN_SKILLS = [
    "python", "javascript", "typescript", "java", "c++", "c#", "go", "rust", "react", "angular",
    "vue", "django", "flask", "fastapi", "node.js", "docker", "kubernetes", "aws", "azure",
    "gcp", "git", "linux", "sql", "mysql", "postgresql", "mongodb", "redis", "tensorflow",
    "pytorch", "pandas", "numpy", "scikit-learn", "html", "css", "bootstrap", "tailwind",
]

# --- fixed values: text patterns ----------------------------------------------
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4,6}"
PERSON_NAME = r"^[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,3}$"
CITY_REGION = (
    r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,2})\s*,\s*([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,2})\b"
)
DURATION = (
    r"(?i)\b(?:20[0-3]\d|19\d\d)\b|"
    r"\b(?:present|now|current|today|aktif|sekarang|tahun|bulan|years?|months?)\b"
)
MONTH_WORDS = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "present", "now", "current",
]
MONTH_RANGE = (
    r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    r"(?:uary|ruary|ch|ril|e|y|ust|tember|ober|ember)?\s+\d{4}\s*[-–]\s*"
    r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    r"(?:uary|ruary|ch|ril|e|y|ust|tember|ober|ember)?\s+\d{4}|(?:Now|Present|Current))"
)
YEAR_RANGE = r"(?i)\b\d{4}\s*[-–]\s*(?:\d{4}|present|now)\b"
EXPLICIT_YEARS = r"(?i)(\d+\.?\d*)\s*\+?\s*(?:years?|tahun)"
YEAR_2000S = r"\b(20[0-3]\d)\b"
YEAR_ANY = r"\b(20[0-3]\d|19\d\d)\b"
SECTION_HEADERS = {
    "skills": r"(?i)(?:^|\n)\s*(?:technical|key|core|professional)?\s*skills?\s*"
              r"(?:&\s*competenc\w*|&\s*expertise)?[\s:]*(?:\n|$)",
    "experience": r"(?i)(?:^|\n)\s*(?:work|professional|employment|job|career)?\s*experiences?\s*"
                  r"(?:history|record)?[\s:]*(?:\n|$)",
    "education": r"(?i)(?:^|\n)\s*education(?:al)?\s*(?:level|background|history|&\s*qualif\w*)?"
                 r"[\s:]*(?:\n|$)",
}
INSTITUTION_WORDS = [
    "university", "universitas", "institut", "institute", "college", "school", "politeknik",
    "academy", "sma", "smk",
]
DEGREE_WORDS = [
    "computer science", "information systems", "bachelor", "diploma", "master", "s1", "d3", "d4",
    "s2", "s3", "undergraduate", "graduate", "major", "studying", "student",
]

# --- fixed values: span tagging -------------------------------------------------
SPAN_BOUNDARY_TOKEN = r"^[,;/|&•·\-–—]+$|^\($|^\)$|^(?:and|or|AND|OR)$"
SPAN_EXPERIENCE_PAREN = r"(?i)\(.*?(?:year|yr|month|mo|experience|exp).*?\)"
SPAN_DELIMITERS = r"(?i)[,;/|•·&:]+|\band\b|\bor\b"
SPAN_EXPERIENCE_WORDS = r"(?i)\d+\s*(?:year|yr|month|mo)"
SURFACE_DELIMITERS = r"(?i)[,;|•·\n\r\t]+|\s+and\s+|\s+or\s+"
REPAIR_BOUNDARY_TOKEN = (
    r"^[,;/|&+:•·\-–—❖◦~*▪►■□●○→←↑↓★☆]+$|^\($|^\)$|^(?:and|or|AND|OR)$|^https?://|^www\."
)
REPAIR_NOISE_TOKEN = (
    r"(?i)^\d+\+?$"
    r"|^(?:Less|than|year|years|yr|yrs|month|months|mo|mos|experience|exp)$"
    r"|^ADDITIONAL$|^INFORMATION$|^TECHNICAL$|^SKILLS$"
    r"|^Technical$|^skills:?$|^Languages:?$|^Frameworks:?$|^Tools:?$"
    r"|^(?:proficiency|proficient|knowledge|familiar|expertise)$"
    r"|^(?:Environment|Operating|Database|Reporting|Tracking|Ticket)$"
    r"|^(?:Tool|Application|Servers|IDE|Web|Development|Language|Framework)$"
    r"|^(?:in|of|on|for|with|the|a|an|to|at|by)$"
    r"|^(?:nature|Hardworking|Dedicated|towards|work|Efficient|Individual|Highly)$"
    r"|^https?://|^www\."
)
ANNOTATION_LABELS = {
    "Skills": "Skills", "Designation": "Designation", "Name": "Name",
    "Email Address": "Email Address", "Email": "Email Address", "Phone": "Phone",
    "Location": "Location", "Companies worked at": "Companies worked at",
    "Companies Worked At": "Companies worked at",
    "Years of Experience": "Years of Experience", "Degree": "Degree",
    "College Name": "College Name", "Graduation Year": "Graduation Year", "UNKNOWN": "UNKNOWN",
}
TAG_LABELS = {
    "Name": "Name", "Email Address": "Email", "Phone": "Phone", "Location": "Location",
    "Designation": "Designation", "Companies worked at": "Company",
    "Years of Experience": "YearsExperience", "Degree": "Degree", "College Name": "Institution",
    "Graduation Year": "GraduationYear",
}
BLOCK_FIELDS = {
    "Company": "company", "Designation": "designation", "YearsExperience": "duration",
    "Degree": "degree", "Institution": "institution",
}

# --- fixed values: line-block profile parser ---------------------------------------
PERSONAL_HEADERS = [
    "personal information", "personal info", "profile", "summary", "professional summary",
    "about me", "objective", "contact", "contact information",
]
WORK_HEADERS = [
    "work experience", "professional experience", "employment history", "career history",
    "work history", "experience", "work experiences", "professional experiences",
]
EDUCATION_HEADERS = [
    "education", "academic history", "academic background", "qualifications", "training",
    "education level", "education & qualifications", "education and training",
]
SKILLS_HEADERS = ["skills", "technical skills", "core competencies", "competencies", "expertise"]
NEUTRAL_HEADERS = [
    "achievements", "accomplishments", "projects", "project work", "organizational experience",
    "organisational experience", "volunteer experience", "extracurricular activities",
    "activities", "awards", "honors", "honours", "publications", "certifications", "leadership",
    "community involvement", "interests", "hobbies", "achievements & awards",
]
BLOCK_KNOWN_SKILLS = [
    "agile", "airflow", "angular", "aws", "azure", "blender", "bootstrap", "c#", "c++", "ci/cd",
    "communication", "critical thinking", "css", "data analysis", "data science", "django",
    "docker", "fastapi", "flask", "git", "github", "graphql", "html", "javascript",
    "kubernetes", "leadership", "linux", "machine learning", "mysql", "nlp", "node.js", "numpy",
    "pandas", "postgresql", "problem solving", "project management", "public speaking",
    "pytorch", "python", "react", "rest", "research", "scikit-learn", "scrum", "sql",
    "teamwork", "tensorflow", "testing", "typescript", "vue", "adaptability",
]
STOP_SKILL_TOKENS = ["and", "or", "with", "rest", "span", "spanning", "etc", "including"]
GRADE_WORDS = ["gpa", "cgpa", "grade", "grades", "percentage", "percent", "score", "marks"]
FILE_PREFIXES = [
    "cv", "resume", "resumé", "curriculum", "vitae", "profile", "candidate", "final", "draft",
    "updated", "latest",
]
NAME_STOP_WORDS = [
    "education", "student", "university", "college", "institute", "school", "cv", "resume",
    "profile", "objective", "experience", "work", "intern", "internship",
]
WORK_MARKERS = [
    "work experience", "professional experience", "employment history", "career history",
    "responsible for", "managed", "developed", "implemented", "built", "deployed",
    "software engineer", "developer", "analyst", "consultant", "engineer", "intern", "tutor",
    "programmer", "manager", "director",
]
EDUCATION_MARKERS = [
    "education", "academic", "university", "college", "school", "bachelor", "master", "mba",
    "phd", "degree", "diploma", "certificate", "graduation", "gpa", "cgpa",
]
JOB_TITLE_LINE = (
    r"\b(intern|engineer|developer|programmer|tutor|consultant|manager|director|assistant)\b"
)
DATE_WORD = (
    r"(?i)\b(?:19|20)\d{2}\b|\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?"
    r"|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
)
CAPITAL_HEADER = r"^[A-Z][A-Z0-9 &/.,'()-]{2,}$"
NUMERIC_ONLY = r"^\d+(?:[.,]\d+)?(?:/\d+(?:[.,]\d+)?)?%?$"
GRADE_WORD = r"(?i)\b(?:gpa|cgpa|grade|grades|percentage|percent|score|marks?)\b"
DATE_TOKEN = r"^(?:19|20)\d{2}$|^\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?$"

# --- fixed values: answer normalisation ----------------------------------------------
TRAILING_HINT = r"\s*\([^)]*\)\s*$"
PLACEHOLDERS = ["__fill__", "...", "....", "placeholder"]
DIFFICULTY_VALUES = ["easy", "moderate", "challenging"]
DEMAND_VALUES = ["high", "medium", "low"]
CATEGORY_VALUES = ["specialization", "adjacent", "leadership", "pivot"]
READINESS_VALUES = ["low", "moderate", "high", "excellent"]
DEMAND_POINTS = {"high": 100, "medium": 65, "low": 30}
EASE_POINTS = {"easy": 100, "moderate": 60, "challenging": 25}
