"""Stateless graphs over streaming inputs."""
