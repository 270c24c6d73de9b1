import importlib.util

collect_ignore_glob = [] if importlib.util.find_spec("wayfind.llm") else ["test_*.py"]
