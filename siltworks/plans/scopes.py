"""How scopes begin, and what code depends on and exports, by language. All fixed values."""

# A trimmed line that matches begins a scope; the group is its name. Unknown languages take those of javascript.
SCOPE_STARTS = {
    "javascript": (
        r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)",
        r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)",
        r"^(?:export\s+)?class\s+(\w+)",
        r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*class",
    ),
    "typescript": (
        r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)",
        r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*\w+(?:<[^>]+>)?)?\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)",
        r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
        r"^(?:export\s+)?interface\s+(\w+)",
        r"^(?:export\s+)?type\s+(\w+)",
        r"^(?:export\s+)?enum\s+(\w+)",
    ),
    "python": (r"^def\s+(\w+)\s*\(", r"^async\s+def\s+(\w+)\s*\(", r"^class\s+(\w+)"),
    "java": (
        r"^(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*(?:synchronized)?\s*(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(",
        r"^(?:public|private|protected)?\s*(?:abstract)?\s*(?:final)?\s*class\s+(\w+)",
        r"^(?:public|private|protected)?\s*interface\s+(\w+)",
        r"^(?:public|private|protected)?\s*enum\s+(\w+)",
    ),
    "go": (r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", r"^type\s+(\w+)\s+struct", r"^type\s+(\w+)\s+interface"),
    "rust": (
        r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",
        r"^(?:pub\s+)?struct\s+(\w+)",
        r"^(?:pub\s+)?enum\s+(\w+)",
        r"^(?:pub\s+)?trait\s+(\w+)",
        r"^impl(?:<[^>]+>)?\s+(?:\w+(?:<[^>]+>)?\s+for\s+)?(\w+)",
    ),
    "csharp": (
        r"^(?:public|private|protected|internal)?\s*(?:static)?\s*(?:async)?\s*(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(",
        r"^(?:public|private|protected|internal)?\s*(?:abstract)?\s*(?:sealed)?\s*(?:partial)?\s*class\s+(\w+)",
        r"^(?:public|private|protected|internal)?\s*interface\s+(\w+)",
        r"^(?:public|private|protected|internal)?\s*enum\s+(\w+)",
    ),
}
# Kinds of scopes by words of their first line, tried in this order.
SCOPE_KINDS = ((r"class\s+", "class"), (r"interface\s+", "class"), (r"struct\s+", "class"), (r"enum\s+", "class"), (r"function\s+|def\s+|fn\s+|func\s+", "function"), (r"=>\s*\{", "function"))
# What is imported and exported; the group is the name, or a list of names with commas.
DEPENDENCIES = {
    "javascript": (r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    "typescript": (r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    "python": (r"from\s+(\S+)\s+import", r"import\s+(\S+)"),
    "java": (r"import\s+([^;]+);",),
    "go": (r"import\s+(?:\(\s*)?[\"']([^\"']+)[\"']",),
}
EXPORTS = {
    "javascript": (r"export\s+(?:default\s+)?(?:function|class|const|let|var)\s+(\w+)", r"export\s+\{\s*([^}]+)\s*\}", r"module\.exports\s*=\s*(\w+)"),
    "typescript": (r"export\s+(?:default\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)", r"export\s+\{\s*([^}]+)\s*\}"),
    "python": (r"__all__\s*=\s*\[([^\]]+)\]",),
}
