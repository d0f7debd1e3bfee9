"""Column functions: skills, URLs, text, seniority, vectors and small classifications."""
