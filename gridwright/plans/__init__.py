"""Plan building blocks that keep large or skewed groups spread over many tasks."""
