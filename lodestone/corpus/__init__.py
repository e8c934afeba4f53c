"""Work on texts, web pages and conversations: X1, X3, X7, X8."""
