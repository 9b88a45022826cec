"""treeq: tree-shaped queries on PySpark."""
